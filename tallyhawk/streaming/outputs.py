"""Alerts and counts of streams: once each, per window, and the first of each window.

All are Spark's own stateful operators in append mode, so they can follow each other in one
query. A window's groups come out in the batch in which the watermark passes its end, all
of them, so what ranks them needs no state and works on the micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.operators import alerts
from tallyhawk.operators.windows import START, seconds


def once(stream: DataFrame, *columns: str) -> DataFrame:
    """The first row of each combination of ``columns``; repeats up to the watermark's delay apart are left out, after that its state is gone. Needs a watermark."""
    return stream.dropDuplicatesWithinWatermark(list(columns))


def per_window(stream: DataFrame, ts: str, dur: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """``keys, window_start, window_end`` and aggregates of fixed windows, as the watermark passes their ends."""
    window = F.window(ts, f"{seconds(dur)} seconds").alias("w")
    out = stream.groupBy(window, *keys).agg(*aggregates)
    return out.select(*keys, F.col("w.start").alias(START), F.col("w.end").alias("window_end"), *[c for c in out.columns if c not in ("w", *keys)])


def distinct_per_window(stream: DataFrame, ts: str, dur: str, keys: list[str], value: str, out: str) -> DataFrame:
    """Distinct non-null ``value``s of each key and fixed window: repeats are left out first, then the rest is counted.

    The watermark's delay must be at least ``dur``, so that a value is remembered for all of its window.
    """
    slot = F.window(ts, f"{seconds(dur)} seconds")["start"].cast("long").alias("_slot")
    first = once(stream.where(F.col(value).isNotNull()).select("*", slot), *keys, value, "_slot")
    return per_window(first, ts, dur, keys, F.count(F.lit(1)).alias(out))


def top(batch: DataFrame, measure: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` groups of largest ``measure`` of each window in a micro-batch of ``per_window``; for ``foreachBatch``."""
    return alerts.top(batch, [START], measure, n, *ties)
