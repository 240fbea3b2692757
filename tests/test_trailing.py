"""Trailing counts against a plain count of each frame."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import windows


def test_equals_each_frame_counted(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([None, rng.randint(0, 300), rng.randint(0, 300)]), rng.choice([None, *"abcd"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, key int, at long, word string").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.id: (r.n, r.words, r.odd) for r in windows.trailing_counts(df, ["key"], "ts", "10s", words="word", odd="nullif(at % 3, 0)").collect()}
    want = {}
    for i, key, at, _ in rows:
        if at is not None:
            frame = [r for r in rows if r[1] == key and r[2] is not None and at - 10 <= r[2] <= at]
            want[i] = (len(frame), len({r[3] for r in frame} - {None}), len({r[2] % 3 for r in frame} - {0}))
    assert got == want


def test_a_frame_of_a_hundred_thousand_rows(spark):
    df = spark.range(100_000).select("id", F.lit(1).alias("key"), F.timestamp_millis(F.col("id")).alias("ts"), (F.col("id") % 50_000).alias("word"))
    began = time.perf_counter()
    top = windows.trailing_counts(df, ["key"], "ts", "1d", words="word").agg(F.max("n").alias("n"), F.max("words").alias("w"), F.count("*").alias("rows")).head()
    assert (top.n, top.w, top.rows) == (100_000, 50_000, 100_000) and time.perf_counter() - began < 60


def test_one_shuffle_and_names(spark):
    df = spark.range(3).select("id", F.lit(1).alias("key"), F.timestamp_seconds("id").alias("ts"))
    told = windows.trailing_counts(df, ["key"], "ts", "1d", words="id")
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    with pytest.raises(ValueError):
        windows.trailing_counts(df.withColumn("n", F.lit(1)), ["key"], "ts", "1d")
