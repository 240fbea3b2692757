"""Sources, routing, joins, functions, alerts, sinks, reconciliation, lateness and streams."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyhawk.functions import scalars as fn
from tallyhawk.operators import alerts, enrich, match, reconcile
from tallyhawk.operators.match import Step
from tallyhawk.sinks import writers
from tallyhawk.sinks.writers import Sink
from tallyhawk.sources import readers, routing
from tallyhawk.sources.readers import Source
from tallyhawk.sources.schema import conform, event_time, schema
from tallyhawk.streaming import lateness, stateful

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_ndjson_counts_bad_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"sip":"a","dport":"22"}\n\n  \nnot json\n{"sip":"b","extra":1}\n')
    good, bad = readers.read_ndjson(spark, str(tmp_path / "a.ndjson"), schema(sip="ip", dport="chars"))
    assert sorted(tuple(r) for r in good.collect()) == [("a", "22"), ("b", None)]
    assert [r[0] for r in bad.collect()] == ["not json"]
    assert [r.dport for r in conform(good.orderBy("sip"), schema(sip="ip", dport="digit")).collect()] == [22, None]


def test_sources_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sip,n\nx,1\ny,2\n")
    (tmp_path / "b.ndjson").write_text('{"sip":"z"}\n')
    shape = schema(sip="ip", n="digit")
    both = [Source("c", "csv", str(tmp_path / "a.csv")), Source("j", "ndjson", str(tmp_path / "b.ndjson")), Source("off", "csv", "/nowhere", enabled=False)]
    assert sorted(tuple(r) for r in readers.read_all(spark, both, shape).collect()) == [("x", 1, "c"), ("y", 2, "c"), ("z", None, "j")]
    assert readers.read_all(spark, [], shape).count() == 0
    assert readers.kafka_options("h:1", "t", "g") == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "kafka.group.id": "g"}
    with pytest.raises(ValueError):
        readers.static_table(readers.read_csv(spark, str(tmp_path / "a.csv"), shape), 3)


def test_routes_and_misses(spark):
    rows = spark.createDataFrame([("netflow", 1), ("other", 2), (None, 3), (" ", 4)], "stream_tag string, n int")
    tagged = routing.tag(rows)
    assert [r.n for r in routing.window(tagged, "netflow", "n").collect()] == [1]
    assert sorted(tuple(r)[1:] for r in routing.misses(tagged, ["netflow"]).collect()) == [("missing_stream_tag_field", 2), ("unknown_stream_schema", 1)]
    assert routing.window(routing.tag(rows, fixed="netflow"), "netflow").count() == 4


def test_event_time_forms(spark):
    forms = ["1700000000", "1700000000000", "1700000000000000", "1700000000000000000", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20", "junk", None]
    got = spark.createDataFrame([(f,) for f in forms], "t string").select(F.unix_seconds(event_time(F.col("t")))).collect()
    assert [r[0] for r in got] == [1700000000] * 6 + [None] * 2


def test_joins_keep_rows_single(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    dim = spark.createDataFrame([("a", "y"), ("a", "x"), ("c", "z"), (None, "q")], "k string, v string")
    assert sorted((r.n, r.v2) for r in enrich.snapshot(df, dim, {"k": "k"}, {"v2": "v"}, ["v"]).collect()) == [(1, "x"), (2, None), (3, None)]
    assert [r.n for r in enrich.snapshot(df, dim, {"k": "k"}, {"v2": "v"}, ["v"], required=True).collect()] == [1]
    assert sorted(r.n for r in enrich.anti(df, dim, {"k": "k"}).collect()) == [2, 3]
    assert sorted((r.n, r.hit) for r in enrich.exists(df, dim, {"k": "k"}, "hit").collect()) == [(1, True), (2, False), (3, False)]
    assert [r.n for r in enrich.has(df, dim, {"k": "k"}).collect()] == [1]


def test_functions(spark):
    row = spark.range(1).select(
        fn.fmt("{}-{}", F.lit(1), F.lit(None)).alias("f"), fn.stable_id((F.lit("ab"), "string"), (F.lit("c"), "string")).alias("a"),
        fn.stable_id((F.lit("a"), "string"), (F.lit("bc"), "string")).alias("b"), fn.is_internal(F.lit("172.31.0.1")).alias("i"), fn.is_internal(F.lit("172.32.0.1")).alias("o"),
        fn.is_internal(F.lit("10.1.1.999")).alias("bad"), fn.merge(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("2"))).alias("m"),
        fn.now("ms").alias("ms"), fn.now("ns").alias("ns"),
    ).head()
    assert row.f == "1-" and row.a != row.b and row.i and not row.o and not row.bad and row.m == {"a": "2"} and row.ns // 10**9 == row.ms // 1000
    with pytest.raises(ValueError):
        fn.fmt("{}", F.lit(1), F.lit(2))


def some_alerts(spark, n=3):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=i)) for i in range(n)], "i long, ts timestamp")
    return alerts.envelope(df, "r", ("ip", F.col("i")), 70, F.col("ts"), F.lit("close:eos"), extra=F.col("i"))


def test_envelope_and_delivery(spark):
    a = some_alerts(spark)
    assert a.head().close_reason == "eos" and a.head().entity_id == "0"
    out = alerts.deliver(alerts.with_prefix(a), None, ["__tally_e*", "__tally_summary"])
    assert set(out.columns) == {"__tally_rule_name", "__tally_score", "__tally_origin", "__tally_close_reason", "__tally_fired_at", "extra"}
    with pytest.raises(ValueError):
        alerts.deliver(a, None, ["extra"])
    with pytest.raises(ValueError):
        alerts.yields(a, schema(x="digit"), {"y": F.lit(1)})
    assert alerts.distinct(a.unionByName(a)).count() == 3


def test_sinks_write(spark, tmp_path):
    a = some_alerts(spark).withColumn("target", F.when(F.col("extra") == 0, "net_a").when(F.col("extra") == 1, "sec").otherwise("x"))
    sinks = [Sink("n", ("net_*",), "json", str(tmp_path / "n")), Sink("c", ("net_?", "sec"), "count"), Sink("h", ("none",), "blackhole")]
    got = writers.write_all(a, "target", sinks, Sink("default", ("*",), "kv", str(tmp_path / "d"), fields=("extra", "rule_name")))
    assert got["c"] == 2
    assert [json.loads(r.value)["extra"] for r in spark.read.text(str(tmp_path / "n")).collect()] == [0]
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["extra=2 rule_name=r"]
    good, bad = writers.split_errors(spark.createDataFrame([("1", "x"), ("z", "y")], "a string, b string"), schema(a="digit", b="chars"))
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [r._error for r in bad.collect()] == ["a"]


def test_reconcile_pairs(spark):
    shape = "rule_name string, score double, entity_type string, entity_id string, origin string, fired_at timestamp"
    at = lambda s: T0 + timedelta(seconds=s)
    expected = [("r", 70.0, "ip", "a", "event", at(0)), ("r", 70.0, "ip", "a", "event", at(100)), ("r", 70.0, "ip", "b", "close:eos", at(0)), ("r", 70.0, "ip", "c", "event", at(0)), ("r", 1.0, None, "n", "event", at(0))]
    actual = [("r", 70.0, "ip", "a", "event", at(100.5)), ("r", 70.005, "ip", "a", "event", at(0.4)), ("r", 70.0, "ip", "a", "event", at(50)), ("r", 70.0, "ip", "b", "close:flush", at(9)), ("r", 70.0, "ip", "d", "event", at(0)), ("r", 1.0, None, "n", "event", at(0))]
    pairs = reconcile.reconcile(spark.createDataFrame(expected, shape), spark.createDataFrame(actual, shape))
    assert sorted((r.entity_id, r.status) for r in pairs.collect()) == [("a", "matched"), ("a", "matched"), ("a", "unexpected"), ("b", "field_mismatch"), ("c", "missing"), ("d", "unexpected"), ("n", "matched")]
    told = reconcile.report(pairs).head()
    assert (told.matched, told.missing, told.unexpected, told.field_mismatch, told.passed) == (3, 1, 2, 1, False)
    rates = spark.createDataFrame([("r", 0.9, None)], "rule_name string, hit double, miss double")
    assert [r.passed for r in reconcile.checks(rates, [("hit", ">=", 0.8), ("miss", "<=", 0.1)]).collect()] == [True, False]


def test_reconcile_against_a_plain_search(spark):
    """Crowded keys, ties in time and score, prefixed names, nulls."""
    import random

    rnd = random.Random(3)
    shape = "rule_name string, score double, entity_type string, entity_id string, origin string, fired_at timestamp"
    some = lambda n: [("r", float(rnd.choice([10, 20])), "ip", rnd.choice("ab"), "event", T0 + timedelta(seconds=rnd.randrange(40))) for _ in range(n)]
    for n, m in ((60, 60), (80, 30), (10, 70), (0, 5), (5, 0)):
        expected, actual = some(n), some(m)
        want = []
        for k in "ab":
            free = sorted((a[5], a[1]) for a in actual if a[3] == k)
            for t, s in sorted((e[5], e[1]) for e in expected if e[3] == k):
                near = min(free, key=lambda a: abs(a[0] - t), default=None)
                if near:
                    free.remove(near)
                want.append((k, t, s, *(near or (None, None))))
            want += [(k, None, None, *a) for a in free]
        named = alerts.with_prefix(spark.createDataFrame(actual, shape))
        got = reconcile.reconcile(spark.createDataFrame(expected, shape), named).collect()
        utc = lambda t: t and t.replace(tzinfo=timezone.utc)
        assert sorted(map(str, ((r.entity_id, utc(r.expected_at), r.expected_score, utc(r.actual_at), r.actual_score) for r in got))) == sorted(map(str, want))


def test_late_rows(spark):
    rows = [(i, T0 + timedelta(seconds=s)) for i, s in enumerate([0, 100, 50, 95, 200, 100])]
    df = spark.createDataFrame(rows, "n long, ts timestamp").withColumn("slot", F.floor(F.col("n") / 2))
    assert [r.late for r in lateness.marked_late(df, "ts", "n", "10s", "slot").orderBy("n").collect()] == [False, False, True, False, False, True]
    a = lateness.audit(df.unionByName(df.where("n = 5")), "ts", "n", "n", "10s", "slot").head()
    assert (a.rows, a.duplicates, a.late) == (7, 1, 3)
    with pytest.raises(ValueError):
        lateness.retained(df, "ts", "2d", "1d")


def test_revise_recomputes_touched_keys(spark):
    history = spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int")
    late = spark.createDataFrame([("a", 2)], "k string, v int")
    out = stateful.revised(late, ["k"], lambda d: d.groupBy("k").agg(F.sum("v").alias("s")), history)
    assert [tuple(r) for r in out.collect()] == [("a", 3)]
