"""Registered queries of sources, predicates, joins, matching, windows and sequences on the driver's tables.

Each query stands beside its DuckDB form. Times leave as microseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhawk.functions import scalars as fn
from tallyhawk.operators import alerts, enrich, match, windows
from tallyhawk.operators.match import Step
from tallyhawk.plans import sql
from tallyhawk.sources import routing, schema

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


def us(c: str) -> F.Column:
    return windows.micros(c).alias(f"{c}_us")


E = f"({sql.EVENTS})"

# --- sources, routing, schema -------------------------------------------------------------------


@query(f"SELECT tag, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT nullif(event_type, 'error') AS tag, event_id FROM {E}) WHERE tag IN ('click', 'view') GROUP BY tag")
def a9_tag_routing(spark, sf):
    tagged = routing.tag(events(spark, sf).withColumn("stream_tag", F.when(F.col("event_type") != "error", F.col("event_type"))))
    parts = [routing.window(tagged, t, F.lit(t).alias("tag"), "event_id") for t in ("click", "view")]
    return parts[0].unionByName(parts[1]).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"SELECT 'fixed' AS tag, user_id, count(*) AS n FROM {E} GROUP BY user_id")
def a8_fixed_tag(spark, sf):
    return routing.window(routing.tag(events(spark, sf), fixed="fixed"), "fixed").groupBy(F.col("_tag").alias("tag"), "user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'wide' AS win, event_id, event_type, value FROM {E} WHERE event_type = 'click' UNION ALL SELECT 'narrow', event_id, NULL, NULL FROM {E} WHERE event_type = 'click' AND k >= 50")
def a10_fan_out(spark, sf):
    tagged = routing.tag(events(spark, sf), field="event_type")
    wide = routing.window(tagged, "click", F.lit("wide").alias("win"), "event_id", "event_type", "value")
    narrow = routing.window(tagged, "click", F.lit("narrow").alias("win"), "event_id", "k").where("k >= 50").drop("k")
    return wide.unionByName(narrow, allowMissingColumns=True)


@query(
    f"SELECT 'events' AS source, CASE WHEN event_type = 'error' THEN 'missing_stream_tag_field' ELSE 'unknown_stream_schema' END AS reason, count(*) AS rows FROM {E} "
    "WHERE event_type NOT IN ('click', 'view') GROUP BY ALL"
)
def a11_route_miss(spark, sf):
    rows = events(spark, sf).withColumn("stream_tag", F.when(F.col("event_type") != "error", F.col("event_type"))).withColumn("_source", F.lit("events"))
    return routing.misses(routing.tag(rows), ["click", "view"])


@query(
    "SELECT event_id, CAST(trunc(value) AS BIGINT) AS value, TRY_CAST(event_type AS BIGINT) AS event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS BIGINT) AS absent, "
    "CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM events"
)
def a12_conform(spark, sf):
    shape = schema.schema(event_id="digit", value="digit", event_type="digit", user_id="chars", absent="digit", ts="time")
    raw = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string"))
    return schema.conform(raw, shape).select("*", us("ts")).drop("ts")


@query(
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS t_us FROM events WHERE event_id % 5 < 4 UNION ALL "
    "SELECT event_id, 0 FROM events WHERE event_id % 5 = 4"
)
def a13_ts_normalise(spark, sf):
    rows = events(spark, sf)
    m = windows.micros("ts")
    text = F.when(F.col("event_id") % 5 == 0, (m * 1000).cast("string")).when(F.col("event_id") % 5 == 1, m.cast("string")).when(
        F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ).when(F.col("event_id") % 5 == 3, F.col("ts").cast("string")).otherwise("no time")
    return rows.select("event_id", F.unix_micros(schema.event_time(text, F.timestamp_seconds(F.lit(0)))).alias("t_us"))


@query("SELECT event_id, CAST(epoch_us(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 HOUR END) AS BIGINT) AS t_us FROM events")
def a14_time_inference(spark, sf):
    rows = events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("_timestamp"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("event_time"))
    return rows.select("event_id", F.unix_micros(schema.infer_time(rows, ["event_time"])).alias("t_us"))


@query(f"SELECT source, count(*) AS n, count(value) AS with_value FROM (SELECT 'events' AS source, value FROM {E} UNION ALL SELECT 'orders', NULL FROM orders) GROUP BY source")
def a6_multi_source(spark, sf):
    a = events(spark, sf).select(F.lit("events").alias("source"), "value")
    b = table(spark, sf, "orders").select(F.lit("orders").alias("source"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"))


# --- predicates and projections -------------------------------------------------------------------


@query(f"SELECT event_id, user_id, value FROM {E} WHERE event_type = 'purchase' AND value >= 50")
def c1_bind_filter(spark, sf):
    return events(spark, sf).where((F.col("event_type") == "purchase") & (F.col("value") >= 50)).select("event_id", "user_id", "value")


@query(f"SELECT event_id FROM {E} WHERE (event_type <> 'click' AND value < 10) OR (NOT (k <= 50) AND value > 90)")
def c2_boolean_algebra(spark, sf):
    e = events(spark, sf)
    return e.where(((F.col("event_type") != "click") & (F.col("value") < 10)) | (~(F.col("k") <= 50) & (F.col("value") > 90))).select("event_id")


PROBES = [r"(?i)<script", r"\bhref=", r"(?i)on(click|load)=", r"[0-9]{4}"]


@query("SELECT page_id, regexp_matches(html, '(?i)<script') AS script, coalesce(regexp_matches(html, '((?i)<script)|(\\bhref=)|((?i)on(click|load)=)|([0-9]{4})'), FALSE) AS any_probe FROM pages")
def c4_regex_probe(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.col("html").rlike(PROBES[0]).alias("script"), fn.regex_any(F.col("html"), PROBES).alias("any_probe"))


@query(
    f"SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value >= 50) AS large, count(*) FILTER (event_type = 'click' AND value >= 50) AS both_ FROM {E} GROUP BY user_id"
)
def c5_multi_alias(spark, sf):
    flagged = events(spark, sf).withColumns({"a": F.col("event_type") == "click", "b": F.col("value") >= 50})
    return flagged.groupBy("user_id").agg(F.count_if("a").alias("clicks"), F.count_if("b").alias("large"), F.count_if(F.col("a") & F.col("b")).alias("both_"))


@query(f"SELECT 'row_trigger' AS rule_name, CAST(70 AS DOUBLE) AS score, 'user' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, 'event' AS origin, {sql.us('ts')} AS fired_at_us, event_id FROM {E} WHERE event_type = 'error' AND k >= 90")
def c6_row_trigger(spark, sf):
    hits = events(spark, sf).where((F.col("event_type") == "error") & (F.col("k") >= 90))
    return _flat(alerts.envelope(hits, "row_trigger", ("user", F.col("user_id")), 70, F.col("ts"), event_id=F.col("event_id")), "event_id")


def _flat(a: DataFrame, *more: str) -> DataFrame:
    return a.select("rule_name", "score", "entity_type", "entity_id", "origin", us("fired_at"), *more)


@query(f"SELECT event_id, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS level, CASE WHEN event_type = 'error' THEN CAST(k + 50 AS DOUBLE) ELSE CAST(-k AS DOUBLE) END AS score FROM {E}")
def c9_if_else(spark, sf):
    return events(spark, sf).select(
        "event_id", F.when(F.col("value") >= 50, "high").otherwise("low").alias("level"),
        F.when(F.col("event_type") == "error", F.col("k") + 50).otherwise(-F.col("k")).cast("double").alias("score"),
    )


@query(f"SELECT event_id, 'audit' AS team, 'own' AS alert_type, CAST(user_id AS VARCHAR) AS sip, CAST(NULL AS VARCHAR) AS detail, CAST(k AS BIGINT) AS request_count FROM {E} WHERE event_type = 'signup'")
def c11_preset(spark, sf):
    base, kind = {"team": F.lit("soc"), "alert_type": F.lit("base")}, {"team": F.lit("audit"), "sip": F.col("user_id")}
    shape = schema.schema(event_id="digit", team="chars", alert_type="chars", sip="ip", detail="chars", request_count="digit")
    rows = events(spark, sf).where("event_type = 'signup'")
    return alerts.yields(rows, shape, alerts.preset(base, kind, alert_type=F.lit("own"), event_id=F.col("event_id"), request_count=F.col("k").cast("string")))


# --- joins -------------------------------------------------------------------


def customers(spark, sf):
    return table(spark, sf, "customer")


ALLOWED = "SELECT c_custkey FROM customer WHERE c_acctbal < 0"


@query(f"SELECT event_id, user_id FROM {E} WHERE user_id NOT IN ({ALLOWED})")
def d1_whitelist_anti(spark, sf):
    return enrich.anti(events(spark, sf), customers(spark, sf).where("c_acctbal < 0"), {"user_id": "c_custkey"}).select("event_id", "user_id")


@query(f"SELECT event_id, c_mktsegment AS department, c_name AS owner FROM {E} LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON user_id = c_custkey")
def d2_snapshot_enrich(spark, sf):
    owners = customers(spark, sf).where("c_acctbal >= 0")
    return enrich.snapshot(events(spark, sf), owners, {"user_id": "c_custkey"}, {"department": "c_mktsegment", "owner": "c_name"}, ["c_name"]).select("event_id", "department", "owner")


@query(f"SELECT event_id, o_orderkey AS last_order FROM {E} JOIN (SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) ON user_id = o_custkey")
def d3_guarded_snapshot(spark, sf):
    return enrich.snapshot(events(spark, sf), table(spark, sf, "orders"), {"user_id": "o_custkey"}, {"last_order": "o_orderkey"}, ["o_orderdate", "o_orderkey"], required=True).select("event_id", "last_order")


@query(f"SELECT event_id, c_mktsegment AS department FROM {E} LEFT JOIN customer ON user_id = c_custkey WHERE user_id NOT IN ({ALLOWED})")
def d4_chained(spark, sf):
    c = customers(spark, sf)
    kept = enrich.anti(events(spark, sf), c.where("c_acctbal < 0"), {"user_id": "c_custkey"})
    return enrich.snapshot(kept, c, {"user_id": "c_custkey"}, {"department": "c_mktsegment"}, ["c_name"]).select("event_id", "department")


@query(f"SELECT event_id, user_id IN ({ALLOWED}) AS listed FROM {E}")
def d5_exists(spark, sf):
    return enrich.exists(events(spark, sf), customers(spark, sf).where("c_acctbal < 0"), {"user_id": "c_custkey"}, "listed").select("event_id", "listed")


@query(f"SELECT event_id, c_mktsegment AS verdict FROM {E} JOIN customer ON user_id = c_custkey WHERE c_mktsegment IS NOT NULL AND c_acctbal >= 5000")
def d6_value(spark, sf):
    found = enrich.snapshot(events(spark, sf), customers(spark, sf).where("c_acctbal >= 5000"), {"user_id": "c_custkey"}, {"verdict": "c_mktsegment"}, ["c_name"])
    return found.where(F.col("verdict").isNotNull()).select("event_id", "verdict")


@query(f"SELECT event_id FROM {E} SEMI JOIN (SELECT o_custkey, dayofmonth(o_orderdate) AS d FROM orders) ON user_id = o_custkey AND dayofmonth(ts) = d")
def d7_composite(spark, sf):
    known = table(spark, sf, "orders").select("o_custkey", F.dayofmonth("o_orderdate").alias("d"))
    return enrich.has(events(spark, sf).withColumn("day", F.dayofmonth("ts")), known, {"user_id": "o_custkey", "day": "d"}).select("event_id")


@query(f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM {E} WHERE user_id NOT IN ({ALLOWED})) WHERE n = 1")
def d8_first_seen(spark, sf):
    e = enrich.anti(events(spark, sf), customers(spark, sf).where("c_acctbal < 0"), {"user_id": "c_custkey"})
    return enrich.first_seen(e, ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, coalesce(user_id IN ({ALLOWED}), FALSE) AS hit, CAST(NULL AS VARCHAR) AS missing FROM {E}")
def d9_lookup_defaults(spark, sf):
    e = enrich.exists(events(spark, sf), customers(spark, sf).where("c_acctbal < 0"), {"user_id": "c_custkey"}, "hit")
    return enrich.snapshot(e, customers(spark, sf).where("c_custkey < 0"), {"user_id": "c_custkey"}, {"missing": "c_name"}, ["c_name"]).select("event_id", "hit", "missing")


@query(f"SELECT event_id FROM {E} WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def d10_has(spark, sf):
    return enrich.has(events(spark, sf), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), {"user_id": "o_custkey"}).select("event_id")


# --- thresholds in anchored windows ------------------------------------------------------------


def _firings(spark, sf, name, dur, steps, on_fire="reset", keys=("user_id",), score=70):
    """Alerts of a chain; the events' own value keeps out of the way of the measure."""
    own = events(spark, sf).withColumnRenamed("value", "amount")
    found = match.firings(match.track(own, list(keys), "ts", "event_id", dur, steps, on_fire))
    out = alerts.envelope(found, name, ("user", F.col("user_id")), score, F.col("ts"), event_id=F.col("event_id"), measure=F.round("value", 4))
    return _flat(out, "event_id", "measure")


SOURCE = "SELECT event_id, ts, user_id, event_type, value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _firings_sql(name, dur, steps, on_fire="reset", keys=("user_id",), score=70):
    return (
        sql.chain(SOURCE, list(keys), dur, steps, on_fire)
        + f" SELECT '{name}' AS rule_name, CAST({score} AS DOUBLE) AS score, 'user' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, 'event' AS origin, "
        f"{sql.us('ts')} AS fired_at_us, event_id, round(measure, 4) AS measure FROM w WHERE fired"
    )


def _matching(name, *args, **kwargs):
    def run(spark, sf):
        return _firings(spark, sf, name, *args, **kwargs)

    run.__name__ = name
    run.__doc__ = f"Firings of {name} over {args[0]} windows."
    query(_firings_sql(name, *args, **kwargs))(run)


CLICKS = [Step("event_type = 'click'", 3)]
_matching("e1_count_threshold", "2d", CLICKS)
_matching("e1_count_once", "2d", CLICKS, "once")
_matching("e1_count_every", "2d", CLICKS, "every")
_matching("e2_distinct", "2d", [Step("TRUE", 3, "distinct", "event_type")])
_matching("e2_distinct_every", "2d", [Step("TRUE", 3, "distinct", "event_type")], "every")
_matching("e3_sum", "1d", [Step("event_type = 'purchase'", 100, "sum", "amount")])
_matching("e4_avg", "1d", [Step("TRUE", 60, "avg", "amount", guard="amount > 5")])
_matching("e5_compound_key", "5d", [Step("TRUE", 3)], keys=("user_id", "event_type"))
_matching("e7_any_of", "1d", [match.any_of(Step("event_type = 'error'", 2), Step("amount >= 20", 90, "sum", "amount"), Step("k < 50", 3, "distinct", "event_type"))])
_matching("f5_sequence3", "3d", [Step("event_type = 'view'", 1), Step("event_type = 'click'", 1), Step("event_type = 'purchase'", 1)], score=90)
_matching("f6_counted_sequence", "3d", [Step("event_type = 'view'", 2), Step("event_type IN ('click', 'error')", 2)], score=90)
_matching("f7_sum_sequence", "2d", [Step("event_type = 'view'", 50, "sum", "amount"), Step("event_type = 'purchase'", 50, "sum", "amount")])
_matching("c7_step_guard", "1d", [Step("event_type <> 'view'", 2, guard="k >= 50")])
