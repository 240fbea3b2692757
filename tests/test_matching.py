"""Cases of thresholds, closings and sequences, and independence of input order."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import match, windows
from tallyhawk.operators.match import Step
from tallyhawk.plans import detections as d
from tallyhawk.plans import rule

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def table(spark, rows, names, step=10):
    """Rows of (seconds or None, fields...); None goes ``step`` seconds after the row before."""
    out, at = [], -step
    for i, (t, *rest) in enumerate(rows):
        at = at + step if t is None else t
        out.append((i, T0 + timedelta(seconds=at), *rest))
    random.Random(5).shuffle(out)
    kinds = {int: "bigint", str: "string"}
    shape = "event_id bigint, ts timestamp, " + ", ".join(f"{n} {kinds[type(rows[0][1 + k])]}" for k, n in enumerate(names))
    return spark.createDataFrame(out, shape).repartition(3)


def said(found):
    return sorted((r.entity_id, r.origin, r.score) for r in found.collect())


def test_count_hit_and_below(spark):
    r = d.brute_force_count(3)
    rows = [(None, "10.0.0.1", "failed")] * 3
    assert said(rule.run(r, table(spark, rows, ["sip", "result"]))) == [("10.0.0.1", "close:eos", 70.0)]
    assert said(rule.run(r, table(spark, rows[:2], ["sip", "result"]))) == []


def test_distinct_hit_repeat_and_isolated(spark):
    r = d.port_scan_distinct(10)
    names = ["sip", "dport", "action"]
    assert len(said(rule.run(r, table(spark, [(None, "a", p, "syn") for p in range(10)], names)))) == 1
    assert said(rule.run(r, table(spark, [(None, "a", p % 9, "syn") for p in range(18)], names))) == []
    assert said(rule.run(r, table(spark, [(None, "ab"[p % 2], p, "syn") for p in range(10)], names))) == []


def test_average_on_every_event(spark):
    r = d.dns_tunnel_avg(500)
    assert said(rule.run(r, table(spark, [(None, "a", v) for v in (200, 200, 1100)], ["sip", "resp_size"]))) == [("a", "event", 70.0)]
    assert said(rule.run(r, table(spark, [(None, "a", v) for v in (50, 60)], ["sip", "resp_size"]))) == []


def test_sum_with_or_close(spark):
    r, names, mb = d.data_exfil(), ["sip", "bytes"], 1_000_000
    slow = [(None, "a", 12 * mb)] * 5 + [(660, "b", 1)]
    assert said(rule.run(r, table(spark, slow, names))) == [("a", "close:timeout", 85.0)]
    burst = said(rule.run(r, table(spark, [(None, "a", 25 * mb)] * 4, names)))
    assert burst == [("a", "close:eos", 85.0), ("a", "event", 85.0)]
    assert said(rule.run(r, table(spark, [(None, "a", 1000), (None, "a", 2000)], names))) == []


def test_chain(spark):
    full = [(None, "a", "syn")] * 5 + [(None, "a", "login_fail")] * 3
    assert said(rule.run(d.chain_attack(), table(spark, full, ["sip", "action"]))) == [("a", "event", 90.0)]
    assert said(rule.run(d.chain_attack(), table(spark, full[:5], ["sip", "action"]))) == []
    assert said(rule.run(d.chain_attack(), table(spark, full[5:] + full[:5], ["sip", "action"]))) == []


def test_close_reasons(spark):
    r = d.close_demo()
    rows = [(0, "a", 200), (10, "a", 300), (20, "b", 250), (30, "b", 100)]
    assert said(rule.run(r, table(spark, rows, ["sip", "bytes"]))) == [("a", "close:eos", 70.0)]
    assert said(rule.run(r, table(spark, rows, ["sip", "bytes"]), end_reason="flush")) == [("a", "close:flush", 70.0)]
    assert said(rule.run(r, table(spark, rows, ["sip", "bytes"]), end_reason=None)) == []
    later = [*rows, (360, "c", 999)]
    assert said(rule.run(r, table(spark, later, ["sip", "bytes"]), end_reason=None)) == [("a", "close:timeout", 70.0)]
    close = rule.run(r, table(spark, later, ["sip", "bytes"])).where("entity_id = 'a'").head()
    assert close.fired_at == datetime(2024, 1, 1, 0, 5) and close.close_reason == "timeout"


def test_boundary_and_refiring(spark):
    five = table(spark, [(0, "a"), (299, "a"), (300, "a")], ["sip"])
    got = windows.anchored(five, ["sip"], "ts", "event_id", "5m").orderBy("event_id").collect()
    assert [r.row_in_window for r in got] == [1, 2, 1]
    seven = table(spark, [(None, "a")] * 7, ["sip"])
    for mode, n in (("reset", 2), ("once", 1), ("every", 5)):
        assert match.firings(match.track(seven, ["sip"], "ts", "event_id", "5m", [Step("TRUE", 3)], mode)).count() == n
        two = match.track(seven, ["sip"], "ts", "event_id", "5m", [Step("TRUE", 3, "sum", "1")], mode)
        assert match.firings(two).count() == n


def test_multi_alias_completes_strictly_later(spark):
    rows = table(spark, [(None, "a", 5)] * 4, ["sip", "v"])
    got = match.firings(match.track(rows, ["sip"], "ts", "event_id", "5m", [Step("v > 1", 2), Step("v > 2", 2)])).collect()
    assert [r.event_id for r in got] == [3]


def test_sequence_over_two_sources(spark):
    names = ["sip", "dip", "dport", "bytes_out", "src", "result"]
    one = [(None, "a", "x", 22, 500, "conn", ""), (None, "a", "x", 0, 0, "auth", "success"), (None, "a", "x", 80, 20_000, "conn", "")]
    many = [(t, s, "x" + dip, *rest) for dip in "123" for t, s, _, *rest in one]
    assert len(said(rule.run(d.rat_propagation(), table(spark, many, names)))) == 3
    assert said(rule.run(d.rat_propagation(), table(spark, one[:2], names))) == []
    assert len(said(rule.run(d.rat_propagation_exploit(), table(spark, [one[0], one[2]], names)))) == 1
    assert said(rule.run(d.rat_propagation_exploit(), table(spark, one[:1], names))) == []


def test_pipeline_needs_refiring(spark):
    rows = table(spark, [(0, "a"), (1, "a")], ["sip"])
    first = rule.run(rule.Rule("one", ("sip",), "5m", (Step("TRUE", 1),), 1, ("ip", "sip")), rows)
    second = rule.Rule("two", ("sip",), "5m", (Step("TRUE", 2),), 2, ("ip", "sip"))
    assert [x[0] for x in said(rule.run(second, rule.alerts_as_events(first, {"sip": F.col("entity_id")})))] == ["a"]


def test_sqli_and_empty_input(spark):
    uris = ["/a?id=1%27"] * 3 + ["/b?q=union all select", "/c?x=1=1", "/home", "/home"]
    rows = table(spark, [(None, "a", "GET", u) for u in uris], ["sip", "method", "uri"])
    assert len(said(rule.run(d.sqli_probe(), d.marked_sqli(rows)))) == 1
    assert said(rule.run(d.sqli_probe(), d.marked_sqli(rows.limit(0)))) == []


def test_rules_depend_without_cycles():
    assert rule.ordered({"b": {"a"}, "c": {"b"}})[-1] == "c"
    with pytest.raises(ValueError):
        rule.ordered({"a": {"b"}, "b": {"a"}})


@pytest.mark.parametrize("steps", [[Step("v > 2", 3)], [Step("TRUE", 12, "sum", "v")], [Step("TRUE", 3, "distinct", "v")], [Step("v < 4", 2), Step("v >= 4", 2)]])
def test_order_of_input_does_not_matter(spark, steps):
    rnd = random.Random(9)
    rows = [(i, T0 + timedelta(seconds=rnd.randrange(4000)), rnd.choice("abc"), rnd.randrange(8)) for i in range(300)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, k string, v bigint").repartition(1 + seed)
        got = match.track(df, ["k"], "ts", "event_id", "5m", steps).collect()
        seen.add(tuple(sorted((r.event_id, str(r.window_start), r.fired, r.value) for r in got)))
    assert len(seen) == 1


def test_null_keys_and_times(spark):
    rows = [(1, T0, None), (2, T0, None), (3, None, "a"), (4, T0, "a")]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, k string")
    got = windows.anchored(df, ["k"], "ts", "event_id", "5m").collect()
    assert sorted((r.event_id, r.row_in_window) for r in got) == [(1, 1), (2, 2), (4, 1)]
    cut = windows.stretches(df.where("ts IS NOT NULL"), ["k"], "ts", "5m", "part")
    assert cut.count() == 3


def test_alternatives_keep_their_own_thresholds(spark):
    step = match.any_of(Step("kind = 'error'", 2), Step("amount >= 50", 100, "sum", "amount"), Step("TRUE", 4, "distinct", "kind"))
    r = rule.Rule("either", ("who",), "10m", (step,), 10, ("user", "who"))
    names = ["who", "kind", "amount"]
    run = lambda rows: len(said(rule.run(r, table(spark, rows, names))))
    assert run([(None, "a", "error", 1), (None, "a", "ok", 60)]) == 0
    assert run([(None, "a", "error", 1), (None, "a", "error", 1)]) == 1
    assert run([(None, "a", "ok", 60), (None, "a", "ok", 49), (None, "a", "ok", 50)]) == 1
    assert run([(None, "a", k, 1) for k in "abcd"]) == 1 and run([(None, "a", k, 1) for k in "abca"]) == 0


def test_close_guard_on_the_reason(spark):
    r = d.brute_force_count(1, "1m").with_(close="count(*) >= 1 AND close_reason = 'timeout'")
    rows = table(spark, [(0, "a", "failed"), (100, "b", "failed")], ["sip", "result"])
    assert said(rule.run(r, rows)) == [("a", "close:timeout", 70.0)]
    assert said(rule.run(r.with_(close="close_reason = 'eos'"), rows)) == [("b", "close:eos", 70.0)]
    assert said(rule.run(r.with_(close="close_reason = 'flush'"), rows, end_reason="flush")) == [("b", "close:flush", 70.0)]


def test_even_intervals(spark):
    r = d.heartbeat(4, 1.0, "1h", 200)
    names = ["sip", "dip", "bytes_out"]
    even, uneven = [(60 * k, "a", "x", 10) for k in range(5)], [(60 * k + 7 * (k % 2), "b", "x", 10) for k in range(5)]
    assert said(rule.run(r, table(spark, even + uneven, names))) == [("a", "close:eos", 90.0)]


@pytest.mark.parametrize("on_fire", ["reset", "once", "every"])
def test_split_keys_and_clashing_columns(spark, on_fire):
    """A hot key dealt to several tasks gives what one task gives, whatever the event's columns are called."""
    rnd = random.Random(2)
    rows, at = [], 0
    for i in range(400):
        at += rnd.choice([1, 5, 20, 400])
        rows.append((i, T0 + timedelta(seconds=at), "hot" if i % 3 else None, i % 7, i, 1, 2, 3))
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, who string, k bigint, _t bigint, _k int, _f0_0 int, _row int").repartition(3)
    steps = [Step("k < 5", 2, "distinct", "k"), Step("k > 2", 6, "sum", "k")]
    whole = match.track(df, ["who"], "ts", "event_id", "1m", steps, on_fire)
    part = windows.stretches(df, ["who"], "ts", "1m", "part")
    assert part.select("part").distinct().count() > 20
    split = match.track(part, ["who"], "ts", "event_id", "1m", steps, on_fire, ["part"])
    assert split.drop("part").columns == whole.columns
    assert sorted(map(str, split.drop("part").collect())) == sorted(map(str, whole.collect()))
    one = windows.anchored(df, ["who"], "ts", "event_id", "1m")
    assert sorted((r._t, r.window_start) for r in one.collect()) == sorted((r._t, r.window_start) for r in windows.anchored(part, ["who"], "ts", "event_id", "1m", ["part"]).collect())
    r = rule.Rule("hot", ("who",), "1m", tuple(steps), 1, ("user", "who"), on_fire=on_fire)
    told = lambda f: sorted(str((r.entity_id, r.fired_at)) for r in f.collect())
    assert told(rule.run(r, df, split=True)) == told(rule.run(r, df))
