"""Late rows as a change log: which firings they take back and which they add.

A late row touches its key from the window that it falls into (or opens) on, and no further
than the first pause of a whole window after it, behind which the same windows open again.
Only that range of a touched key's history is read and matched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.operators.match import FIRED, STEP, VALUE, Step, firings, track
from tallyhawk.operators.windows import START, micros, named_apart, seconds

CHANGE = "change"


def _ranges(tracked: DataFrame, late: DataFrame, keys: list[str], ts: str, dur: str) -> DataFrame:
    """Per touched key (as ``_k<i>``): from which time on, and before which, its rows can change."""
    span, own = seconds(dur) * 1_000_000, [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    touched = late.select(*named, micros(ts).alias("t")).groupBy(*own).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    rows = tracked.select(*named, micros(ts).alias("t"), micros(START).alias("start")).join(touched.withColumnsRenamed({o: f"x{o}" for o in own}), [F.col(o).eqNullSafe(F.col(f"x{o}")) for o in own])
    before = F.greatest(F.lag("t").over(Window.partitionBy(*own).orderBy("t")), F.col("high"))
    rows = rows.withColumn("pause", (F.col("t") > F.col("high")) & (F.col("t") - F.coalesce(before, F.col("high")) >= span))
    known = rows.groupBy(*own).agg(F.max(F.when(F.col("start") <= F.col("low"), F.col("start"))).alias("start"), F.min(F.when(F.col("pause"), F.col("t"))).alias("_until"))
    whole = touched.join(known.withColumnsRenamed({o: f"r{o}" for o in own}), [F.col(o).eqNullSafe(F.col(f"r{o}")) for o in own], "left")
    opens = F.when(F.col("low") < F.col("start") + span, F.col("start")).otherwise(F.col("low"))
    return whole.select(*[o for o in own], F.coalesce(opens, F.col("low")).alias("_from"), "_until")


def revisions(tracked: DataFrame, late: DataFrame, keys: list[str], ts: str, order: str, dur: str, steps: list[Step], on_fire: str = "reset") -> DataFrame:
    """``change, <the event's columns>, window_start, step, fired, value``: firings to retract and to upsert once ``late`` has come.

    ``tracked`` is ``track`` of all rows before, with the same arguments; ``late`` has its
    events' columns. A firing whose window or measure changes is retracted and upserted. No
    late rows, or late rows that change nothing, give no changes.
    """
    columns = [c for c in tracked.columns if c not in (START, STEP, FIRED, VALUE)]
    named_apart(columns, CHANGE)
    own = [f"_k{i}" for i in range(len(keys))]
    late = late.select(*columns).where(F.col(ts).isNotNull()).where(" OR ".join(f"({s.when})" for s in steps))
    ranges = _ranges(tracked, late, keys, ts, dur)
    within = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)] + [micros(ts) >= F.col("_from"), F.col("_until").isNull() | (micros(ts) < F.col("_until"))]
    old = tracked.join(ranges, within).select(tracked.columns)
    new = track(old.select(*columns).unionByName(late), keys, ts, order, dur, steps, on_fire)
    gone, come = firings(old), firings(new).select(tracked.columns)
    # One aggregation tells both differences; a firing is told by all its columns.
    counted = gone.withColumn("_n", F.lit(-1)).unionByName(come.withColumn("_n", F.lit(1))).groupBy(*tracked.columns).agg(F.sum("_n").alias("_n"))
    times = F.explode(F.sequence(F.lit(1), F.abs("_n")))
    return counted.where("_n <> 0").select(F.when(F.col("_n") < 0, "retract").otherwise("upsert").alias(CHANGE), *tracked.columns, times.alias("_each")).drop("_each")
