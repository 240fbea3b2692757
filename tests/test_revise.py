"""Revisions against the difference of two whole runs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import match, revise
from tallyhawk.operators.match import Step

SHAPE = "event_id long, key string, at long, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE).withColumn("ts", F.timestamp_seconds("at"))


def counted(rows):
    return Counter((r.event_id, r.key, r.window_start, r.value) for r in rows)


@pytest.mark.parametrize("steps,on_fire", [([Step("TRUE", 3)], "reset"), ([Step("v > 2", 2), Step("TRUE", 9, "sum", "v")], "reset"), ([Step("TRUE", 3, "distinct", "v")], "every")])
@pytest.mark.parametrize("spacing", [5, 40])
def test_equals_the_difference_of_two_runs(spark, steps, on_fire, spacing):
    rng = random.Random(spacing)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randint(0, 100 * spacing), rng.randint(0, 6)) for i in range(400)]
    late_ids = set(rng.sample(range(400), 6))
    before, late = frame(spark, [r for r in rows if r[0] not in late_ids]), frame(spark, [r for r in rows if r[0] in late_ids])
    run = lambda df: match.track(df, ["key"], "ts", "event_id", "1m", steps, on_fire)
    got = revise.revisions(run(before), late, ["key"], "ts", "event_id", "1m", steps, on_fire).collect()
    old, new = counted(match.firings(run(before)).collect()), counted(match.firings(run(frame(spark, rows))).collect())
    assert counted(r for r in got if r.change == "retract") == old - new
    assert counted(r for r in got if r.change == "upsert") == new - old
    assert got or spacing == 40


def test_only_touched_ranges_are_read(spark):
    rows = [(i, "a", 10 * i, 1) for i in range(100)] + [(200 + i, "a", 5000 + 10 * i, 1) for i in range(100)] + [(400 + i, "b", 10 * i, 1) for i in range(50)]
    late = frame(spark, [(900, "a", 455, 1)])
    tracked = match.track(frame(spark, rows), ["key"], "ts", "event_id", "1m", [Step("TRUE", 2)])
    ranges = revise._ranges(tracked, late, ["key"], "ts", "1m").collect()
    assert [tuple(r) for r in ranges] == [("a", 420_000_000, 5_000_000_000)]


def test_nothing_late_and_a_new_key(spark):
    steps = [Step("TRUE", 2)]
    tracked = match.track(frame(spark, [(1, "a", 0, 1), (2, "a", 10, 1)]), ["key"], "ts", "event_id", "1m", steps)
    told = lambda rows: sorted((r.change, r.event_id) for r in revise.revisions(tracked, frame(spark, rows), ["key"], "ts", "event_id", "1m", steps).collect())
    assert told([]) == []
    assert told([(5, "z", 3, 1), (6, "z", 4, 1)]) == [("upsert", 6)]
    assert told([(7, "a", 5, 1)]) == [("retract", 2), ("upsert", 7)]
