"""Registered queries of functions, lateness, reconciliation and routing to sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyhawk.functions import scalars as fn
from tallyhawk.operators import alerts, match, reconcile, revise
from tallyhawk.operators.match import Step
from tallyhawk.operators.windows import micros
from tallyhawk.plans import rule, rule_queries, sql
from tallyhawk.plans.core_queries import SOURCE, E, events, table, us
from tallyhawk.plans.rule_queries import _FIRST, _MANY, view, view_sql
from tallyhawk.sinks import writers
from tallyhawk.sinks.writers import Sink
from tallyhawk.streaming import lateness, outputs, stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# --- scalar functions -----------------------------------------------------------------------


@query(f"SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' at ' || coalesce(CASE WHEN k >= 50 THEN CAST(k AS VARCHAR) END, '') || '!' AS text FROM {E}")
def h1_fmt(spark, sf):
    return events(spark, sf).select("event_id", fn.fmt("user {} did {} at {}!", F.col("user_id"), F.col("event_type"), F.when(F.col("k") >= 50, F.col("k"))).alias("text"))


_BLANK = "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN '' ELSE event_type END"


@query(
    f"SELECT event_id, x IS NULL OR trim(x) = '' AS blank, CASE WHEN trim(x) <> '' THEN x END AS null_if, CASE WHEN x IS NULL OR trim(x) = '' THEN 'none' ELSE x END AS default_if, coalesce(x, 'n') AS co, x IS NOT NULL AS nn FROM (SELECT event_id, {_BLANK} AS x FROM {E})"
)
def h5_blank_kit(spark, sf):
    x = F.col("x")
    rows = events(spark, sf).select("event_id", F.expr(_BLANK).alias("x"))
    return rows.select("event_id", fn.is_blank(x).alias("blank"), fn.null_if_blank(x).alias("null_if"), fn.default_if_blank(x, F.lit("none")).alias("default_if"), F.coalesce(x, F.lit("n")).alias("co"), x.isNotNull().alias("nn"))


@query(f"SELECT event_id, md5(event_type) AS m, sha1(event_type) AS s1, sha256(event_type) AS s2, lower(hex(event_type)) AS hx, lower(to_hex(k)) AS hn FROM {E}")
def h8_hashes(spark, sf):
    t = F.col("event_type")
    return events(spark, sf).select("event_id", F.md5(t).alias("m"), F.sha1(t).alias("s1"), F.sha2(t, 256).alias("s2"), fn.hex_text(t).alias("hx"), fn.hex_text(F.col("k")).alias("hn"))


@query(f"SELECT event_id, sha256('s:' || strlen(event_type) || ':' || event_type || 'i:' || strlen(CAST(k AS VARCHAR)) || ':' || k || 'n:0:') AS id FROM {E}")
def h10_stable_id(spark, sf):
    return events(spark, sf).select("event_id", fn.stable_id((F.col("event_type"), "string"), (F.col("k"), "bigint"), (F.lit(None), "string")).alias("id"))


@query(f"SELECT event_id, '{{\"kind\":\"' || event_type || '\",\"k\":' || k || '}}' AS obj FROM {E}")
def h12_object(spark, sf):
    return events(spark, sf).select("event_id", fn.json_object(kind=F.col("event_type"), k=F.col("k")).alias("obj"))


@query(f"SELECT event_id, '[\"' || event_type || '\",\"' || k || '\"]' AS arr FROM {E}")
def h13_array(spark, sf):
    return events(spark, sf).select("event_id", fn.json_array(F.col("event_type"), F.col("k").cast("string")).alias("arr"))


@query(f"SELECT event_id, 'a=1,b=' || CASE WHEN k >= 50 THEN CAST(k AS VARCHAR) ELSE '2' END || CASE WHEN k >= 50 THEN ',c=3' ELSE '' END AS merged FROM {E}")
def h14_merge(spark, sf):
    one = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    two = F.when(F.col("k") >= 50, F.create_map(F.lit("b"), F.col("k").cast("string"), F.lit("c"), F.lit("3")))
    pairs = F.array_sort(F.transform(F.map_entries(fn.merge(one, two)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return events(spark, sf).select("event_id", F.array_join(pairs, ",").alias("merged"))


_IP = "CASE k % 5 WHEN 0 THEN '10.' WHEN 1 THEN '172.16.' WHEN 2 THEN '192.168.' WHEN 3 THEN '172.40.' ELSE '8.8.' END || (k % 256) || CASE k % 5 WHEN 0 THEN '.1.2' ELSE '.7' END"


@query(f"SELECT event_id, k % 5 < 3 AS internal FROM {E}")
def h16_is_internal(spark, sf):
    return events(spark, sf).select("event_id", fn.is_internal(F.expr(_IP)).alias("internal"))


# --- late and disordered input ------------------------------------------------------------------

_ARRIVED = f"SELECT *, (event_id * 7919) % 10007 AS arrival FROM {E}"
_LATE = "ts < max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {} SECOND"


def _arrived(spark, sf):
    """Events in a shuffled order of arrival; ``arrival`` is unique with the id behind it."""
    rows = events(spark, sf).withColumn("arrival", F.col("event_id") * 7919 % 10007)
    return rows.withColumn("arrival", F.col("arrival") * 1_000_000_000 + F.col("event_id")).withColumn("slot", F.floor(F.col("arrival") / 500_000_000_000))


@query(f"SELECT event_id, coalesce({_LATE.format(20 * 86400)}, FALSE) AS late FROM ({_ARRIVED})")
def i4_late_side_output(spark, sf):
    good, late = lateness.side_output(lateness.marked_late(_arrived(spark, sf), "ts", "arrival", "20d", "slot"))
    return good.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(f"SELECT late, count(*) AS n FROM (SELECT coalesce({_LATE.format(21 * 86400)}, FALSE) AS late FROM ({_ARRIVED})) GROUP BY late")
def i2_lateness(spark, sf):
    """Counts with one more day allowed on top of a delay of twenty."""
    return lateness.marked_late(_arrived(spark, sf), "ts", "arrival", "21d", "slot").groupBy("late").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id FROM {E} WHERE ts >= (SELECT max(ts) FROM {E}) - INTERVAL 5 DAY")
def i6_retention(spark, sf):
    return lateness.retained(events(spark, sf), "ts", "5d", "10d").select("event_id")


@query(
    f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS duplicates, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order, CAST(sum(CASE WHEN l THEN 1 ELSE 0 END) AS BIGINT) AS late "
    f"FROM (SELECT {_LATE.format(0)} AS o, {_LATE.format(20 * 86400)} AS l FROM ({_ARRIVED}))"
)
def i11_input_audit(spark, sf):
    return lateness.audit(_arrived(spark, sf), "ts", "arrival", "event_id", "20d", "slot")


_STREAM = [Step("event_type IN ('click', 'view')", 3, "distinct", "k")]


@query(
    sql.chain(SOURCE, ["user_id"], "3d", _STREAM)
    + f" SELECT event_id, CAST(measure AS DOUBLE) AS value, {sql.us('window_start')} AS window_start_us FROM w WHERE fired AND epoch_us(ts) <= ((SELECT epoch_ms(max(ts)) FROM events WHERE event_type IN ('click', 'view')) - 86400000) * 1000"
)
def i_stream_equals_batch(spark, sf):
    """Firings of a stream over the events, run to its end: those that the last watermark has passed."""
    path = f"{sf}/events.parquet"
    shape = spark.read.parquet(path).schema
    raw = spark.readStream.schema(shape).parquet(f"{sf}/events*.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumnRenamed("value", "amount")
    found = stateful.tracked(lateness.watermarked(raw, "ts", "1d"), ["user_id"], "ts", "event_id", "3d", _STREAM)
    base = f"{stateful.shared_folder(spark)}/{uuid.uuid4()}"
    stateful.drain(found, f"{base}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    out = spark.read.parquet(f"{base}/out")
    return out.select("event_id", "value", us("window_start"))


_REVISED = [Step("event_type = 'view'", 1), Step("event_type IN ('click', 'error')", 40, "sum", "amount")]
_ARRIVAL = f"SELECT event_id, ts, user_id, event_type, value AS amount, {_LATE.format(20 * 86400)} AS late FROM ({_ARRIVED})"
_FIRES = f"SELECT event_id, {sql.us('window_start')} AS window_start_us, round(measure, 4) AS measure FROM {{}} WHERE fired"


@query(
    sql.chain(f"SELECT event_id, ts, user_id, event_type, amount FROM ({_ARRIVAL}) WHERE NOT coalesce(late, FALSE)", ["user_id"], "3d", _REVISED, name="a") + ", "
    + sql.chain(f"SELECT event_id, ts, user_id, event_type, value AS amount FROM {E}", ["user_id"], "3d", _REVISED, name="b").removeprefix("WITH RECURSIVE ")
    + f" SELECT 'retract' AS change, * FROM ({_FIRES.format('a')} EXCEPT {_FIRES.format('b')}) UNION ALL SELECT 'upsert', * FROM ({_FIRES.format('b')} EXCEPT {_FIRES.format('a')})"
)
def i5_revise(spark, sf):
    """What late rows take back and add, against two runs over all rows."""
    good, late = lateness.side_output(lateness.marked_late(_arrived(spark, sf), "ts", "arrival", "20d", "slot"))
    own = [x.select("event_id", "ts", "user_id", "event_type", F.col("value").alias("amount")) for x in (good, late)]
    tracked = match.track(own[0], ["user_id"], "ts", "event_id", "3d", _REVISED)
    found = revise.revisions(tracked, own[1], ["user_id"], "ts", "event_id", "3d", _REVISED)
    return found.select("change", "event_id", us("window_start"), F.round("value", 4).alias("measure"))


_TIMED = rule_queries._OPEN.with_(name="stream_timeout", dur="2d")


@query(rule.oracle(_TIMED, rule_queries.view_sql("conn"), "1d", None))
def f9_stream_close(spark, sf):
    """A rule with a closing condition on a stream: windows that the last watermark has passed."""
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    rows = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    conn = lateness.watermarked(rows, "ts", "1d").selectExpr(*rule_queries.BASE, *[f"{e} AS {c}" for c, e in rule_queries.VIEWS["conn"].items()])
    base = f"{stateful.shared_folder(spark)}/{uuid.uuid4()}"
    followed = stateful.followed(_TIMED, conn)
    stateful.drain(followed, f"{base}/state", lambda batch, n: rule.flat(stateful.alerts_of(_TIMED, batch)).write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").drop("batch")


def _events_stream(spark, sf, delay: str):
    shape = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(shape).parquet(f"{sf}/events*.parquet").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return lateness.watermarked(raw, "ts", delay)


@query(f"SELECT event_id, user_id FROM {E}")
def g5_stream_dedup(spark, sf):
    """Events that arrive twice on a stream, once each."""
    base = f"{stateful.shared_folder(spark)}/{uuid.uuid4()}"
    twice = _events_stream(spark, sf, "2d").unionByName(_events_stream(spark, sf, "2d"))
    stateful.drain(outputs.once(twice, "event_id"), f"{base}/state", lambda batch, n: batch.select("event_id", "user_id").write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").drop("batch")


@query(
    f"SELECT * FROM (SELECT window_start_us, user_id, scan, row_number() OVER (PARTITION BY window_start_us ORDER BY scan DESC, user_id) AS rank FROM (SELECT {sql.us('time_bucket(INTERVAL 1 DAY, ts)')} AS window_start_us, user_id, count(DISTINCT k) AS scan FROM {E} WHERE k IS NOT NULL GROUP BY ALL HAVING count(DISTINCT k) >= 3) "
    f"WHERE window_start_us + 86400000000 <= ((SELECT epoch_ms(max(ts)) FROM {E} WHERE k IS NOT NULL) - 2 * 86400000) * 1000) WHERE rank <= 2"
)
def f12_stream_top(spark, sf):
    """The two widest scanners of every day that the watermark has passed: two stateful operators in one stream, ranked batch by batch."""
    base = f"{stateful.shared_folder(spark)}/{uuid.uuid4()}"
    counted = outputs.distinct_per_window(_events_stream(spark, sf, "2d"), "ts", "1d", ["user_id"], "k", "scan")

    def each(batch, n):
        first = outputs.top(batch.where("scan >= 3"), F.col("scan"), 2, "user_id")
        first.select(us("window_start"), "user_id", "scan", F.col("rank").cast("bigint").alias("rank")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    stateful.drain(counted, f"{base}/state", each)
    return spark.read.parquet(f"{base}/out").drop("batch")


_TURNS = 3
_BY_TURN = f"SELECT event_id, ts, ((event_id * 7919) % 10007) * {_TURNS} // 10007 AS turn FROM {E}"


@query(
    f"SELECT event_id, turn, coalesce(epoch_us(ts) <= (SELECT epoch_ms(max(o.ts)) - 20 * 86400000 FROM ({_BY_TURN}) o WHERE o.turn < w.turn) * 1000, FALSE) AS late FROM ({_BY_TURN}) w"
)
def i4_stream_side_output(spark, sf):
    """Late rows of a stream that is stopped twice and goes on from its checkpoint; every row comes out, late or as a match."""
    rows = events(spark, sf).withColumn("turn", F.expr(f"event_id * 7919 % 10007 * {_TURNS} div 10007"))
    base = f"{stateful.shared_folder(spark)}/{uuid.uuid4()}"
    for turn in range(_TURNS):
        rows.where(F.col("turn") == turn).write.mode("append").parquet(f"{base}/in")
        read = spark.readStream.schema(rows.schema).parquet(f"{base}/in").withColumnRenamed("value", "amount")
        stream = stateful.tracked(lateness.watermarked(read, "ts", "20d"), ["user_id"], "ts", "event_id", "1d", [Step("TRUE", 1)])
        stateful.drain(stream, f"{base}/state", lambda batch, n: batch.select("event_id", "turn", (F.col("kind") == "late").alias("late")).write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    # Rows that no watermark has passed still wait in the state when the input ends.
    out = spark.read.parquet(f"{base}/out").drop("batch")
    waiting = rows.join(out, "event_id", "left_anti").select("event_id", "turn", F.lit(False).alias("late"))
    return out.unionByName(waiting).select("event_id", F.col("turn").cast("bigint").alias("turn"), "late")


# --- reconciliation -------------------------------------------------------------------------------

_FOUND = rule.oracle(_FIRST, view_sql("conn"))
#: Actual alerts: every 7th is lost, every 5th has another score, every 11th comes 3 seconds later, every 13th is also there under another origin.
_BY = "CAST(entity_id AS BIGINT)"
_ACTUAL = (
    f"SELECT *, score + CASE WHEN n % 5 = 0 THEN 10 ELSE 0 END AS s, fired_at_us + CASE WHEN n % 11 = 0 THEN 3000000 ELSE 500000 END AS moved FROM (SELECT *, fired_at_us // 1000 + {_BY} AS n FROM ({_FOUND})) WHERE n % 7 <> 0"
)


def _sides(spark, sf):
    found = rule.run(_FIRST, view(spark, sf, "conn"))
    n = F.floor(micros("fired_at") / 1000) + F.col("entity_id").cast("bigint")
    moved = F.timestamp_micros(micros("fired_at") + F.when(n % 11 == 0, 3_000_000).otherwise(500_000))
    actual = found.where(n % 7 != 0).select(
        "rule_name", (F.col("score") + F.when(n % 5 == 0, 10).otherwise(0)).alias("score"), "entity_type", "entity_id", "origin", moved.alias("fired_at")
    )
    more = actual.where("cast(entity_id as bigint) % 13 = 0").withColumn("origin", F.concat(F.lit("x"), "origin"))
    return found, actual.unionByName(more)


#: The nearest actual alert not taken yet, for each expected one in turn; used holds the places taken.
_NEAR = "list_transform(free, lambda i: abs(ts[i] - t))"
_PAIRS = f"""WITH RECURSIVE ex AS (SELECT entity_id, origin, score, fired_at_us AS t, row_number() OVER (PARTITION BY entity_id, origin ORDER BY fired_at_us, score) AS rn FROM ({_FOUND})),
act AS (SELECT entity_id, origin, s, moved FROM ({_ACTUAL}) UNION ALL SELECT entity_id, 'x' || origin, s, moved FROM ({_ACTUAL}) WHERE {_BY} % 13 = 0),
ac AS (SELECT entity_id, origin, list(moved ORDER BY moved, s) AS ts, list(s ORDER BY moved, s) AS ss FROM act GROUP BY ALL),
st AS (SELECT DISTINCT entity_id, origin, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM ex
 UNION ALL SELECT entity_id, origin, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM
  (SELECT *, free[list_position({_NEAR}, list_min({_NEAR}))] AS pick FROM
   (SELECT e.entity_id, e.origin, e.rn, e.t, st.used, ac.ts, list_filter(range(1, coalesce(len(ac.ts), 0) + 1), lambda i: NOT list_contains(st.used, i)) AS free
    FROM st JOIN ex e ON e.entity_id = st.entity_id AND e.origin = st.origin AND e.rn = st.rn + 1 LEFT JOIN ac ON ac.entity_id = e.entity_id AND ac.origin = e.origin))),
both_ AS (SELECT e.entity_id, e.origin, e.t AS expected_us, e.score AS es, ac.ts[st.pick] AS actual_us, ac.ss[st.pick] AS s FROM ex e JOIN st USING (entity_id, origin, rn) LEFT JOIN ac USING (entity_id, origin)
 UNION ALL SELECT entity_id, origin, NULL, NULL, m, s FROM (SELECT a.entity_id, a.origin, unnest(a.ts) AS m, unnest(a.ss) AS s, unnest(range(1, len(a.ts) + 1)) AS i, u.used FROM ac a LEFT JOIN
   (SELECT entity_id, origin, arg_max(used, rn) AS used FROM st GROUP BY ALL) u USING (entity_id, origin)) WHERE used IS NULL OR NOT list_contains(used, i))
SELECT entity_id, origin, CASE WHEN actual_us IS NULL THEN 'missing' WHEN expected_us IS NULL THEN 'unexpected'
 WHEN abs(es - s) <= 0.01 AND abs(expected_us - actual_us) <= 1000000 THEN 'matched' ELSE 'field_mismatch' END AS status, coalesce(expected_us, -1) AS expected_us, coalesce(actual_us, -1) AS actual_us FROM both_"""


@query(_PAIRS)
def j1_reconcile(spark, sf):
    """Alerts of each entity against themselves with losses, shifts and repeats: every key has several on both sides."""
    pairs = reconcile.reconcile(*_sides(spark, sf))
    return pairs.select("entity_id", "origin", "status", *[F.coalesce(micros(f"{c}_at"), F.lit(-1)).alias(f"{c}_us") for c in ("expected", "actual")])


@query(
    f"SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected, count(*) FILTER (status = 'field_mismatch') AS field_mismatch, "
    f"count(*) FILTER (status <> 'unexpected') AS expected_total, count(*) FILTER (status <> 'missing') AS actual_total, bool_and(status = 'matched') AS passed FROM ({_PAIRS})"
)
def j2_report(spark, sf):
    return reconcile.report(reconcile.reconcile(*_sides(spark, sf)))


_LABELS = f"SELECT 'stage_one' AS rule_name, CAST(user_id AS VARCHAR) AS entity_id, CASE user_id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'near_miss' ELSE 'miss' END AS kind, epoch_us(min(ts)) AS ev FROM {E} GROUP BY user_id"


@query(
    "SELECT rule_name, round(avg(CASE WHEN kind = 'hit' THEN a END), 6) AS hit, round(avg(CASE WHEN kind = 'near_miss' THEN a END), 6) AS near_miss, round(avg(CASE WHEN kind = 'miss' THEN a END), 6) AS miss, "
    "round(sum(CASE WHEN kind = 'hit' THEN a END) / sum(a), 6) AS precision, round(avg(CASE WHEN kind = 'hit' THEN a END), 6) AS recall, round(avg(CASE WHEN kind <> 'hit' THEN a END), 6) AS fpr, "
    "round(quantile_cont(CASE WHEN kind = 'hit' AND a = 1 THEN (seen - ev) / 1e6 END, 0.95), 3) AS latency_p95 FROM (SELECT l.*, seen, CASE WHEN seen IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS a "
    f"FROM ({_LABELS}) l LEFT JOIN (SELECT entity_id, min(fired_at_us) AS seen FROM ({_FOUND}) WHERE {_BY} % 4 <> 0 GROUP BY entity_id) f USING (entity_id)) GROUP BY rule_name"
)
def j7_quality(spark, sf):
    u = F.col("user_id")
    labels = events(spark, sf).groupBy("user_id").agg(F.min("ts").alias("last_evidence")).select(
        F.lit("stage_one").alias("rule_name"), u.cast("string").alias("entity_id"), F.when(u % 3 == 0, "hit").when(u % 3 == 1, "near_miss").otherwise("miss").alias("case"), "last_evidence"
    )
    found = rule.run(_FIRST, view(spark, sf, "conn")).where("cast(entity_id as bigint) % 4 <> 0")
    q = reconcile.quality(labels, found)
    return q.select("rule_name", *[F.round(c, 6).alias(c) for c in ("hit", "near_miss", "miss", "precision", "recall", "fpr")], F.round("latency_p95", 3).alias("latency_p95"))


@query(f"SELECT rule_name, CAST(100 AS BIGINT) AS expected, count(*) AS actual, count(*) = 100 AS passed FROM ({_FOUND}) GROUP BY rule_name")
def j8_counts(spark, sf):
    found = rule.run(_FIRST, view(spark, sf, "conn"))
    return reconcile.counts_against(found, found.select("rule_name").distinct().withColumn("expected", F.lit(100)))


# --- sinks -------------------------------------------------------------------------------------------

_SINKS = [Sink("scans", ("*scan*",)), Sink("flows", ("data_exfiltration", "netflow_*")), Sink("all", ("*",))]
_ROUTED = " UNION ALL ".join(f"SELECT rule_name FROM ({rule.oracle(r, view_sql('conn'), name=f'w{i}')})" for i, r in enumerate(_MANY))


def _alerts(spark, sf):
    rows = view(spark, sf, "conn")
    return rule.run_all(_MANY, {r.name: rows for r in _MANY})


@query(
    f"SELECT sink, rule_name, count(*) AS n FROM (SELECT rule_name, unnest(CASE WHEN rule_name = 'netflow_syn_scan' THEN ['scans', 'flows'] WHEN rule_name LIKE '%scan%' THEN ['scans'] WHEN rule_name = 'data_exfiltration' THEN ['flows'] ELSE ['default'] END) AS sink FROM ({_ROUTED})) GROUP BY ALL"
)
def b1_route_counts(spark, sf):
    routed = writers.routed(_alerts(spark, sf), "rule_name", _SINKS[:2])
    return routed.groupBy(F.col("_sink").alias("sink"), "rule_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN TRY_CAST(t AS BIGINT) IS NULL THEN 'k' ELSE '' END AS error FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS t FROM events)")
def b3_error_route(spark, sf):
    from tallyhawk.sources.schema import schema

    rows = events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")).alias("k"))
    good, bad = writers.split_errors(rows, schema(event_id="digit", k="digit"))
    return good.select("event_id", F.lit("").alias("error")).unionByName(bad.select("event_id", F.col("_error").alias("error")))


@query(f"SELECT rule_name AS __tally_rule_name, entity_id AS __tally_entity_id, round(measure, 4) AS measure FROM ({_FOUND})")
def b5_meta_drop(spark, sf):
    out = alerts.with_prefix(rule.run(_FIRST, view(spark, sf, "conn")))
    p = alerts.PREFIX
    return alerts.deliver(out, [f"{p}rule_name", f"{p}entity_type", f"{p}entity_id", f"{p}emit_time", "measure"], [f"{p}entity_t*", f"{p}emit_time"])


@query(f"SELECT 'rule_name=' || rule_name || ' score=' || '50.0' || ' entity_id=' || entity_id AS value FROM ({_FOUND})")
def b6_key_values(spark, sf):
    return writers.key_values(rule.run(_FIRST, view(spark, sf, "conn")).select("rule_name", "score", "entity_id"))


@query(f"SELECT 'rule' AS stage, 'emitted_total' AS name, rule_name AS label, count(*) AS value FROM ({_ROUTED}) GROUP BY rule_name UNION ALL SELECT 'source', 'rows_total', 'events', count(*) FROM events")
def b10_metrics(spark, sf):
    emitted = writers.metrics(_alerts(spark, sf), "rule", "emitted_total", "rule_name")
    return emitted.unionByName(writers.metrics(table(spark, sf, "events"), "source", "rows_total", F.lit("events")))


