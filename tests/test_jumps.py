"""The jumping reader against a plain row-by-row reading, in batches of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import match, windows
from tallyhawk.operators.jumps import NOT_NEW, Chains
from tallyhawk.operators.match import Step, any_of

from plain import rowwise

PLANS = [
    ((("count", 3),),), ((("sum", 10.0),),), ((("avg", 4.0),),), ((("distinct", 3),),), ((("sum", 500.0),),), ((("distinct", 30),),), ((("avg", 0.5),),),
    ((("count", 1),), (("count", 1),), (("count", 2),)), ((("count", 2),), (("sum", 9.0),)), ((("distinct", 2),), (("avg", 3.0),), (("count", 1),)),
    ((("count", 4), ("sum", 12.0), ("distinct", 3)),), ((("avg", 6.0), ("distinct", 4)), (("count", 2), ("sum", 5.0))),
]


def made(plan, rng, keys, rows, span, negative):
    out = []
    for key in range(keys):
        t = 0
        for _ in range(rng.randint(1, rows)):
            t += rng.choice([0, 0, 1, 2, span // 9, span // 3, span + 1])
            flags = [[rng.random() < 0.6 for _ in s] for s in plan]
            values = [[rng.choice([None, *range(40 if s[0][1] > 20 else 6)]) if kind == "distinct" else rng.choice([None, 0.1, 1.5, 7.25, -3.3 if negative else 2.0]) for kind, _ in s] for s in plan]
            out.append((key, t, flags, values))
    return out


def jumped(plan, rows, span, on_fire, size):
    """What ``match.track`` does with Spark's columns, on lists."""
    number, seen, prev = {}, {}, []
    for key, _, flags, values in rows:
        n = number[key] = number.get(key, -1) + 1
        told = []
        for i, s in enumerate(plan):
            told.append([])
            for j, (kind, _) in enumerate(s):
                v = values[i][j]
                if kind == "distinct":
                    at = (key, i, j, v)
                    told[-1].append(seen.get(at, -1) if flags[i][j] and v is not None else NOT_NEW)
                    if flags[i][j]:
                        seen[at] = n
                else:
                    told[-1].append(v or 0.0)
        prev.append(told)
    chains, out = Chains(plan, span, on_fire), []
    for at in range(0, len(rows), size):
        part, told = rows[at : at + size], prev[at : at + size]
        keys = [r[0] for r in part]
        cuts = [0, *[k for k in range(1, len(part)) if keys[k] != keys[k - 1]], len(part)]
        flags = [[np.array([r[2][i][j] for r in part]) for j in range(len(s))] for i, s in enumerate(plan)]
        values = [[np.array([p[i][j] for p in told], np.int64 if kind == "distinct" else float) for j, (kind, _) in enumerate(s)] for i, s in enumerate(plan)]
        (start, inside), (step, completes), fired, (value, _) = chains.read([keys[c] for c in cuts[:-1]], cuts, np.array([r[1] for r in part], np.int64), flags, values)
        for k in range(len(part)):
            out.append((int(start[k]) if inside[k] else None, int(step[k]) if completes[k] else None, bool(fired[k]), float(value[k]) if completes[k] else None))
    return out


@pytest.mark.parametrize("on_fire", ["reset", "once", "every"])
@pytest.mark.parametrize("plan", PLANS, ids=str)
def test_equals_rowwise(plan, on_fire):
    rng = random.Random(str(plan) + on_fire)
    for turn in range(12):
        rows = made(plan, rng, 6, 120, 50, turn % 2)
        want = rowwise(plan, rows, 50, on_fire)
        for size in (1, 7, 64, 10_000):
            assert jumped(plan, rows, 50, on_fire, size) == want


def test_a_million_distinct_values_of_one_key():
    n = 1_000_000
    chains = Chains(((("distinct", 250_000),),), 1 << 40, "reset")
    fires = 0
    for at in range(0, n, 10_000):
        told = chains.read(["a"], [0, 10_000], np.arange(at, at + 10_000), [[np.ones(10_000, bool)]], [[np.full(10_000, -1)]])
        fires += int(told[2].sum())
        assert len(chains.open.so_far) <= 1
    assert fires == 4


def test_spark_equals_rowwise_over_batches(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.randint(0, 5_000), rng.choice("xyz"), rng.choice([None, "p", "q", "r", "s"]), rng.choice([None, 1.0, 2.5, -0.7])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string, at long, kind string, word string, size double").withColumn("ts", F.timestamp_seconds("at"))
    steps = [any_of(Step("kind = 'x'", 3, "distinct", "word"), Step("kind = 'y'", 4, "sum", "size")), Step("kind <> 'x'", 1.2, "avg", "size", guard="size > 0")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.id: (r.window_start, r.step, r.fired, r.value) for r in match.track(df, ["key"], "ts", "id", "2m", steps).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    fed = [(r[1], r[2] * 1_000_000, [[r[3] == "x", r[3] == "y"], [r[3] != "x" and (r[5] or 0) > 0]], [[r[4], r[5]], [r[5]]]) for r in ordered]
    want = rowwise(match.plan_of(steps), fed, 120_000_000, "reset")
    assert len(got) == len(rows)
    for r, (start, step, fired, value) in zip(ordered, want, strict=True):
        have = got[r[0]]
        assert (have[1], have[2], have[3]) == (step, fired, value)
        assert (have[0] is None) == (start is None) and (start is None or have[0].timestamp() * 1_000_000 == start)


def test_thresholds_and_names_are_checked(spark):
    for measure in ("count", "distinct"):
        with pytest.raises(ValueError):
            Step("TRUE", 0, measure)
    with pytest.raises(ValueError):
        Step("TRUE", 1, "median")
    df = spark.range(3).select("id", F.timestamp_seconds("id").alias("ts"), F.lit(True).alias("Fired"), F.lit(1).alias("row_in_window"))
    for call in (lambda: match.track(df, ["id"], "ts", "id", "5m", [Step("TRUE", 1)]), lambda: windows.anchored(df, ["id"], "ts", "id", "5m")):
        with pytest.raises(ValueError, match="rename"):
            call()
