"""Registered queries whose work goes through files: sources, counting sinks, alert shapes, and late rows dropped from a stream.

The files are written from the given tables to the shared folder first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyhawk.functions import scalars as fn
from tallyhawk.operators import alerts, reconcile
from tallyhawk.plans import rule, rule_queries
from tallyhawk.plans.core_queries import E, events, table, us
from tallyhawk.plans.rule_queries import _FIRST, _MANY, view, view_sql
from tallyhawk.sinks import writers
from tallyhawk.sinks.writers import Sink
from tallyhawk.sources import readers
from tallyhawk.sources.schema import schema
from tallyhawk.streaming import lateness, outputs, stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


def folder(spark) -> str:
    return f"{stateful.shared_folder(spark)}/{uuid.uuid4()}"


@query(
    f"SELECT CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE event_type END AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 10 = 3 THEN 0 ELSE event_id END) AS BIGINT) AS ids FROM {E} GROUP BY 1"
)
def a1_ndjson(spark, sf):
    """Lines of JSON, some cut short and some blank between them: rows by kind, and the count of bad lines."""
    path, whole = folder(spark), F.to_json(F.struct("event_id", "event_type"))
    cut = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{"), F.substring(whole, 8, 9))).otherwise(whole)
    events(spark, sf).select(F.explode(F.when(F.col("event_id") % 4 == 0, F.array(cut, F.lit("  "))).otherwise(F.array(cut))).alias("value")).write.text(path)
    good, bad = readers.read_ndjson(spark, path, schema(event_id="digit", event_type="chars"))
    rows = good.select(F.col("event_type").alias("kind"), "event_id").unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(0).cast("long").alias("event_id")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"SELECT event_id, user_id, event_type, value FROM {E}")
def a2_csv(spark, sf):
    path = folder(spark)
    rows = events(spark, sf).select("event_id", "user_id", "event_type", "value")
    rows.write.option("header", True).csv(path)
    return readers.read_csv(spark, path, rows.schema)


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def a7_static_table(spark, sf):
    """A provider table from CSV that must hold all nations, joined to customers."""
    path = folder(spark)
    names = table(spark, sf, "nation").select("n_nationkey", "n_name")
    names.write.option("header", True).csv(path)
    known = readers.static_table(readers.read_csv(spark, path, names.schema), 25)
    return table(spark, sf, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


_FLOWS = ("data_exfiltration", "netflow_*")
_RULES = " UNION ALL ".join(f"SELECT rule_name FROM ({rule.oracle(r, view_sql('conn'), name=f'w{i}')})" for i, r in enumerate(_MANY))


@query(
    f"SELECT 'flows' AS sink, count(*) FILTER (rule_name = 'data_exfiltration' OR rule_name LIKE 'netflow_%') AS n FROM ({_RULES}) UNION ALL "
    f"SELECT 'rest', count(*) FILTER (rule_name <> 'data_exfiltration' AND rule_name NOT LIKE 'netflow_%') FROM ({_RULES}) UNION ALL SELECT 'json', count(*) FROM ({_RULES})"
)
def b9_count_sinks(spark, sf):
    """Alerts to a counting sink, to files, to nowhere, and the rest to the default, which counts; files are counted as they are read back."""
    rows, path = view(spark, sf, "conn"), folder(spark)
    found = rule.run_all(_MANY, {r.name: rows for r in _MANY})
    sinks = [Sink("flows", _FLOWS, "count"), Sink("flow_files", _FLOWS, "json", path), Sink("nowhere", _FLOWS, "blackhole")]
    told = writers.write_all(found, "rule_name", sinks, Sink("rest", ("*",), "count"))
    writers.write(found.where(~F.col("rule_name").rlike("^(data_exfiltration|netflow_.*)$")), Sink("more", ("*",), "json", path))
    counts = spark.createDataFrame([(k, v) for k, v in told.items() if v is not None], "sink string, n long")
    return counts.unionByName(spark.read.json(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit("json").alias("sink"), "n"))


_REPORT = "SELECT count(*) AS matched, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected, CAST(0 AS BIGINT) AS field_mismatch, count(*) AS expected_total, count(*) AS actual_total, TRUE AS passed FROM ({})"


@query(_REPORT.format(rule.oracle(_FIRST, view_sql("conn"))))
def j5_alert_shapes(spark, sf):
    """Plain alerts against the same with prefixed names, whose only time is that of emission."""
    found = rule.run(_FIRST, view(spark, sf, "conn"))
    other = alerts.with_prefix(found.withColumn("emit_time", F.col("fired_at")).withColumn("fired_at", F.lit(None).cast("timestamp")))
    return reconcile.report(reconcile.reconcile(found, other))


_ENDING = rule_queries._OPEN.with_(name="by_any_end", dur="60d")


@query(_REPORT.format(rule.oracle(_ENDING, view_sql("conn"), "1d")))
def j6_flush_is_end(spark, sf):
    """Windows flushed against the same windows ended: one origin."""
    rows = view(spark, sf, "conn")
    return reconcile.report(reconcile.reconcile(*[rule.run(_ENDING, rows, delay="1d", end_reason=reason) for reason in ("eos", "flush")]))


@query(f"SELECT event_id, TRUE AS later, TRUE AS agree FROM {E}")
def h11_now(spark, sf):
    """One time of the query for all rows, in every unit."""
    units = [fn.now(u) for u in ("s", "ms", "us", "ns")]
    agree = (units[0] == F.floor(units[1] / 1000)) & (units[1] == F.floor(units[2] / 1000)) & (units[3] == units[2] * 1000)
    return events(spark, sf).select("event_id", (fn.now() > F.col("ts")).alias("later"), agree.alias("agree"))


_TURNS, _DELAY = 3, 12 * 86_400_000
_TURNED = f"SELECT event_id, ts, user_id % 5 AS part, ((event_id * 7919) % 10007) * {_TURNS} // 10007 AS turn, (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS ends FROM {E}"
_MARK = f"(SELECT epoch_ms(max(o.ts)) - {_DELAY} FROM ({_TURNED}) o{{}}) * 1000"


@query(
    f"SELECT part, CAST(ends - 86400000000 AS BIGINT) AS window_start_us, count(*) AS n FROM ({_TURNED}) w WHERE coalesce(ends > {_MARK.format(' WHERE o.turn < w.turn')}, TRUE) AND ends <= {_MARK.format('')} GROUP BY part, ends"
)
def i3_stream_drop(spark, sf):
    """Counts per day of a stream in three turns, rows behind the watermark dropped, days told as the watermark passes them."""
    rows = events(spark, sf).select("event_id", "ts", (F.col("user_id") % 5).alias("part"), F.expr(f"event_id * 7919 % 10007 * {_TURNS} div 10007").alias("turn"))
    base = folder(spark)
    for turn in range(_TURNS):
        rows.where(F.col("turn") == turn).write.mode("append").parquet(f"{base}/in")
        stream = lateness.watermarked(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "ts", "12d")
        counted = outputs.per_window(stream, "ts", "1d", ["part"], F.count(F.lit(1)).alias("n"))
        stateful.drain(counted, f"{base}/state", lambda batch, n: batch.select("part", us("window_start"), "n").write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    return spark.read.parquet(f"{base}/out").drop("batch")
