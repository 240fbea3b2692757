"""Rules on streams against the same rules on the finished input."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import match
from tallyhawk.operators.match import Step
from tallyhawk.plans import rule
from tallyhawk.plans.rule import Rule
from tallyhawk.streaming import lateness, stateful

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SHAPE = "event_id long, ts timestamp, k string, v long"
ROWS = [(i, T0 + timedelta(seconds=i * 8 + (i * 37) % 90, microseconds=i), "ab"[i % 2], i % 7) for i in range(120)]
RULES = {
    "and": Rule("and", ("k",), "1m", (Step("TRUE", 3),), 70, ("key", "k"), close="count(*) >= 5 AND avg(v) > 2"),
    "or": Rule("or", ("k",), "1m", (Step("v > 2", 2),), 60, ("key", "k"), close="max(interval_s) > 10 AND close_reason = 'timeout'", close_mode="or"),
    "chain": Rule("chain", ("k",), "2m", (Step("v > 3", 2), Step("TRUE", 9, "sum", "v")), 80, ("key", "k")),
}


def put(spark, path, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, delay):
    return lateness.watermarked(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path), "ts", delay)


def until(rows, delay, steps):
    """The last watermark: Spark reads it off the rows that are an event of some step."""
    of_some = {"TRUE": lambda v: True, "v > 2": lambda v: v > 2, "v < 4": lambda v: v < 4}
    mark = max(r[1] for r in rows if any(of_some[s.when](r[3]) for s in steps)) - timedelta(seconds=delay)
    return mark.replace(microsecond=mark.microsecond // 1000 * 1000)


@pytest.mark.parametrize(
    "steps,on_fire", [([Step("v > 2", 2)], "once"), ([Step("v < 4", 1), Step("TRUE", 9, "sum", "v")], "reset"), ([Step("TRUE", 3, "distinct", "v")], "every"), ([Step("TRUE", 3, "avg", "v")], "reset")]
)
def test_firings_equal_batch_up_to_the_watermark(spark, tmp_path, steps, on_fire):
    path = str(tmp_path / "in")
    for part in range(3):
        put(spark, path, ROWS[part * 40 : part * 40 + 40])
    got = []
    stateful.drain(stateful.tracked(source(spark, path, "4m"), ["k"], "ts", "event_id", "5m", steps, on_fire), str(tmp_path / "cp"), lambda batch, _: got.extend(batch.collect()))
    batch = match.firings(match.track(spark.createDataFrame(ROWS, SHAPE), ["k"], "ts", "event_id", "5m", steps, on_fire)).collect()
    want = sorted((r.event_id, r.window_start, r.value, r.ts) for r in batch if r.ts.replace(tzinfo=timezone.utc) <= until(ROWS, 240, steps))
    assert sorted((r.event_id, r.window_start, r.value, r.ts) for r in got) == want != []
    assert {r.kind for r in got} == {"fired"}


@pytest.mark.parametrize("name", RULES)
def test_a_rule_goes_on_from_its_checkpoint(spark, tmp_path, name):
    r, path, got = RULES[name], str(tmp_path / "in"), []
    put(spark, path, ROWS[:70])
    put(spark, path, ROWS[70:90])

    def run():
        followed = stateful.followed(r, source(spark, path, "2m"))
        stateful.drain(followed, str(tmp_path / "cp"), lambda batch, _: got.extend(rule.flat(stateful.alerts_of(r, batch)).collect()))

    run()
    put(spark, path, ROWS[90:])
    put(spark, path, [(999, T0 + timedelta(hours=2), "z", 6)])
    run()
    # By then the watermark has passed all rows but the last, which is of another key.
    whole = spark.createDataFrame([*ROWS, (999, T0 + timedelta(hours=2), "z", 6)], SHAPE)
    want = sorted(map(tuple, rule.flat(rule.run(r, whole, delay="2m", end_reason=None)).where("entity_id <> 'z'").collect()), key=str)
    assert sorted(map(tuple, got), key=str) == want != []


def test_late_rows_come_out_and_none_is_lost(spark, tmp_path):
    path, fired, late = str(tmp_path / "in"), [], []
    put(spark, path, [(i, T0 + timedelta(seconds=10 * i), "a", 1) for i in range(60)])
    put(spark, path, [(100, T0 + timedelta(hours=1), "b", 1)])
    put(spark, path, [(200 + i, T0 + timedelta(seconds=10 * i + 5), "a", i) for i in range(4)] + [(300, T0 + timedelta(hours=1), "b", 1)])
    put(spark, path, [(400, T0 + timedelta(hours=3), "c", 1)])

    def each(batch, _):
        batch.persist()
        late.extend(tuple(r) for r in stateful.late_of(batch).collect())
        fired.extend(r.event_id for r in batch.where("fired").collect())
        batch.unpersist()

    stateful.drain(stateful.tracked(source(spark, path, "1m"), ["k"], "ts", "event_id", "5m", [Step("TRUE", 1)]), str(tmp_path / "cp"), each)
    assert [r[0] for r in sorted(late)] == [200, 201, 202, 203] and sorted(late)[1][2:] == ("a", 1)
    assert sorted(fired) == [*range(60), 100, 300]


def test_a_batch_leaves_keys_without_due_rows_alone(spark, tmp_path):
    """Timers and slots: a key's rows are read when the watermark reaches them, not in every batch."""
    path, reads = str(tmp_path / "in"), []
    put(spark, path, [(i, T0 + timedelta(seconds=i), f"k{i % 50}", 1) for i in range(200)])
    for n in range(3):
        put(spark, path, [(1000 + n, T0 + timedelta(seconds=300 + n), "x", 1)])
    query = stateful.drain(stateful.tracked(source(spark, path, "10m"), ["k"], "ts", "event_id", "5m", [Step("TRUE", 9)]), str(tmp_path / "cp"), lambda batch, _: batch.collect())
    for p in query.recentProgress:
        for op in p.stateOperators:
            reads.append(op.numRowsUpdated)
    assert reads[0] >= 50 and max(reads[1:]) < 20
