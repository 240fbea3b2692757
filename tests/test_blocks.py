"""Keys that never pause, cut into blocks, against one reading of the key."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import match, windows
from tallyhawk.operators.match import Step


def told(df):
    return sorted((r.event_id, r.window_start, r.row_in_window) for r in df.collect())


@pytest.mark.parametrize("length,most", [("7s", 0), ("60s", 0), ("5m", 0), ("1h", 0), (None, 50), (None, 100_000)])
def test_blocks_equal_one_reading(spark, length, most):
    rng = random.Random(length)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), None if i % 97 == 0 else rng.choice([rng.randint(0, 4000), rng.randint(0, 400), 90])) for i in range(4000)]
    rows += [(5000 + i, "c", i * 60) for i in range(50)] + [(6000 + i, "d", i * 59) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, key string, at long").withColumn("ts", F.timestamp_seconds("at"))
    cut = windows.blocks(df, ["key"], "ts", "1m", length, most)
    got = windows.anchored(cut, ["key"], "ts", "event_id", "1m")
    assert got.columns == [*df.columns, windows.START, windows.ROW]
    assert told(got) == told(windows.anchored(df, ["key"], "ts", "event_id", "1m"))


def test_one_key_spreads_over_tasks(spark):
    df = spark.range(0, 200_000, 1, 4).select("id", F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 40_000 + F.xxhash64("id") % 20_000).alias("ts"))
    cut = windows.blocks(df, ["key"], "ts", "10s", most=2_000)
    got = windows.anchored(cut, ["key"], "ts", "id", "10s")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 100_000
    whole = windows.anchored(df, ["key"], "ts", "id", "10s")
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_counts_in_blocks(spark):
    df = spark.range(5000).select(F.col("id").alias("event_id"), F.lit(1).alias("key"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), (F.col("id") % 3 == 0).alias("odd"))
    steps = [Step("odd", 4)]
    fire = lambda **how: sorted((r.event_id, r.window_start) for r in match.firings(match.track(df, ["key"], "ts", "event_id", "2m", steps, **how)).collect())
    assert fire(hot=True) == fire() != []


def test_no_rows(spark):
    df = spark.createDataFrame([], "event_id long, key string, ts timestamp")
    assert windows.anchored(windows.blocks(df, ["key"], "ts", "1m"), ["key"], "ts", "event_id", "1m").count() == 0
