"""Late and disordered input: watermarks, what to do with late rows, retention, and an audit of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.operators.windows import micros, seconds


def watermarked(df: DataFrame, ts: str, delay: str, lateness: str = "0s") -> DataFrame:
    """A stream whose stateful operators accept rows up to ``delay`` plus ``lateness`` behind the latest."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds(delay) + seconds(lateness)} seconds")


def marked_late(df: DataFrame, ts: str, arrival: str, delay: str, slots: str) -> DataFrame:
    """A finite input with the boolean ``late``: more than ``delay`` behind the latest event that arrived before.

    ``arrival`` is a unique arrival number. The running maximum goes in two steps: the
    latest event of each earlier slot of arrivals (the integer column ``slots``), then that
    within the slot, so no task holds the whole input.
    """
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(F.col(slots).alias("_s")).agg(F.max(micros(ts)).alias("_m")).select("_s", F.max("_m").over(before).alias("_earlier"))
    inside = Window.partitionBy(slots).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.join(heads, F.col(slots) == F.col("_s"))
    latest = F.greatest(F.max(micros(ts)).over(inside), F.col("_earlier"))
    return rows.withColumn("late", F.coalesce(micros(ts) < latest - seconds(delay) * 1_000_000, F.lit(False))).select(*df.columns, "late")


def side_output(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows)."""
    return marked.where(~F.col("late")).drop("late"), marked.where("late").drop("late")


def retained(df: DataFrame, ts: str, over: str, cap: str | None = None) -> DataFrame:
    """Rows within ``over`` of the latest; ``cap``, if given, must not be shorter."""
    if cap is not None and seconds(cap) < seconds(over):
        raise ValueError("the cap must be at least as long as the retention")
    latest = df.agg(F.max(ts).alias("_latest"))
    return df.join(F.broadcast(latest), F.col(ts) >= F.col("_latest") - F.make_dt_interval(secs=F.lit(seconds(over)))).drop("_latest")


def audit(df: DataFrame, ts: str, arrival: str, event_id: str, delay: str, slots: str) -> DataFrame:
    """One row: counts of rows, rows earlier than one that arrived before, late rows, and repeats of an event id."""
    disorder = marked_late(df, ts, arrival, "0s", slots).select(F.col("late").cast("long").alias("out_of_order"))
    late = marked_late(df, ts, arrival, delay, slots).select(F.col("late").cast("long").alias("late"))
    ids = df.groupBy(event_id).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates"))
    return ids.crossJoin(disorder.agg(F.sum("out_of_order").alias("out_of_order"))).crossJoin(late.agg(F.sum("late").alias("late")))  # one row each
