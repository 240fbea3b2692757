"""Matching keyed events in anchored windows: thresholds, ordered steps, and closing conditions.

``track`` reads each key's rows in time order once and says for every row which window it
is in, which step of the chain it completes and whether it fires. Everything else (alerts,
evidence, conditions judged when a window closes) is ordinary aggregation on its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhawk.operators.jumps import NOT_NEW, Chains
from tallyhawk.operators.windows import START, anchored, blocks, micros, named_apart, runs, seconds, unused

STEP, FIRED, VALUE, CHAIN = "step", "fired", "value", "chain"


@dataclass(frozen=True)
class Step:
    """Reached when ``measure`` over the rows where ``when`` holds is at least ``least``.

    ``measure`` is count, sum, avg or distinct; all but count look at the expression ``of``.
    ``guard`` decides besides ``when`` which rows count. Both are SQL conditions; null is no.
    With ``either`` the step has several thresholds, see ``any_of``. A count or distinct
    threshold must be above 0.
    """

    when: str
    least: float
    measure: str = "count"
    of: str = "1"
    guard: str = ""
    either: tuple[Step, ...] = ()

    def __post_init__(self):
        if self.measure not in ("count", "sum", "avg", "distinct", "any"):
            raise ValueError(f"no measure {self.measure}")
        if self.measure in ("count", "distinct") and not self.least > 0:
            raise ValueError("a count or distinct threshold must be above 0")

    @property
    def flag(self) -> str:
        return f"({self.when}) AND ({self.guard})" if self.guard else self.when

    @property
    def thresholds(self) -> tuple[Step, ...]:
        return self.either or (self,)


def any_of(*steps: Step) -> Step:
    """A step reached when any of ``steps`` is: each keeps its own measure, a row counts for all that it is an event of, and the first reached gives the value."""
    return Step(" OR ".join(f"({s.flag})" for s in steps), 0, "any", either=steps)


def aligned(**aliases: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Events of several windows as one stream: ``src`` names the alias, and each alias' columns are renamed
    to the common key and time names by its map (own name: common name). Columns that one lacks are null there.
    """
    out = None
    for alias, (df, names) in aliases.items():
        part = df.withColumnsRenamed(names).withColumn("src", F.lit(alias))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def plan_of(steps: list[Step]) -> tuple[tuple[tuple[str, float], ...], ...]:
    """(measure, least) of each threshold of each step."""
    return tuple(tuple((t.measure, t.least) for t in s.thresholds) for s in steps)


def inputs_of(steps: list[Step], of: str = "") -> list[Column]:
    """Flag and value of each threshold, as columns ``_f<of><step>_<threshold>`` and ``_v<of><step>_<threshold>``."""
    out = []
    for i, s in enumerate(steps):
        for j, t in enumerate(s.thresholds):
            out.append(F.coalesce(F.expr(t.flag), F.lit(False)).alias(f"_f{of}{i}_{j}"))
            out.append(F.expr(t.of).cast("string" if t.measure == "distinct" else "double").alias(f"_v{of}{i}_{j}"))
    return out


def track(
    df: DataFrame, keys: list[str], ts: str, order: str, dur: str, steps: list[Step], on_fire: str = "reset", parts: list[str] | None = None, hot: bool = False
) -> DataFrame:
    """``df`` with ``window_start, step, fired, value`` of each row; step and value, the measure, where a step is completed.

    Rows that are an event of no step are left out before the shuffle. The first row that
    counts toward step 1 opens a key's window; rows outside a window have none. A row completes at most one step; the next counts strictly later rows, in order of
    (``ts``, ``order``). After the last step the chain starts again within the window
    (``reset``), stays quiet until the next (``once``), or fires on every further row whose
    measure is still there (``every``). Sums and averages skip nothing: a null counts as 0.
    A single count is told from the row's place in its window; other chains go from one
    completed step to the next (``jumps``). With ``hot`` the windows of a single count are
    cut into ``blocks``, so that a key of very many rows is not read by one task. An event column of a result's name is an error.
    """
    if on_fire not in ("reset", "once", "every"):
        raise ValueError(on_fire)
    named_apart(df.columns, START, STEP, FIRED, VALUE)
    if len(steps) == 1 and steps[0].measure == "count":
        return _counted(df, keys, ts, order, dur, steps[0], on_fire, parts, hot)
    chain = Chain(tuple(steps), dur, on_fire)
    return track_all(df, keys, ts, order, [chain], parts).drop(CHAIN)


@dataclass(frozen=True)
class Chain:
    """What ``track_all`` follows: steps in windows of ``dur``; of its rows all are told, those in a window, or those that fire."""

    steps: tuple[Step, ...]
    dur: str
    on_fire: str = "reset"
    tell: str = "all"


def track_all(df: DataFrame, keys: list[str], ts: str, order: str, chains: list[Chain], parts: list[str] | None = None) -> DataFrame:
    """``track`` for several chains of the same keys in one read: each row as often as a chain tells of it, with the chain's number in ``chain``."""
    named_apart(df.columns, START, STEP, FIRED, VALUE, CHAIN)
    names, all_ = df.columns, unused(df.columns, "_row")
    # The event's own columns travel as one struct, so none can clash with what the chains read.
    fields = [
        T.StructField(CHAIN, T.IntegerType()), T.StructField(START, T.TimestampType()), T.StructField(STEP, T.IntegerType()), T.StructField(FIRED, T.BooleanType()),
        T.StructField(VALUE, T.DoubleType()),
    ]
    shape = T.StructType([T.StructField(all_, df.schema), *fields])
    plans = [(plan_of(list(c.steps)), seconds(c.dur) * 1_000_000, c.on_fire) for c in chains]
    tell = [c.tell for c in chains]
    numbered = any(t.measure == "distinct" for c in chains for s in c.steps for t in s.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Chains(*plan) for plan in plans]
        for batch in batches:
            if not len(batch):
                continue
            keys, cuts = runs(batch.column("_k"))
            times = batch.column("_t").to_numpy()
            number = batch.column("_n").to_numpy() if numbered else None
            column = lambda name, null: pc.fill_null(batch.column(name), null).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            for c, (reader, (plan, _, _)) in enumerate(zip(readers, plans, strict=True)):
                rows = np.nonzero(column(f"_w{c}", False))[0]
                if not len(rows):
                    continue
                begins = np.searchsorted(rows, cuts)
                own = [k for k, s, e in zip(keys, begins, begins[1:], strict=False) if e > s]
                own_cuts = [*np.unique(begins[:-1][np.diff(begins) > 0]).tolist(), len(rows)]
                flags = [[column(f"_f{c}_{i}_{j}", False)[rows] for j in range(len(s))] for i, s in enumerate(plan)]
                values = [
                    [
                        None if kind == "count" else column(f"_v{c}_{i}_{j}", NOT_NEW)[rows] if kind == "distinct"
                        else np.nan_to_num(column(f"_v{c}_{i}_{j}", 0.0)[rows], posinf=np.inf, neginf=-np.inf)
                        for j, (kind, _) in enumerate(s)
                    ]
                    for i, s in enumerate(plan)
                ]
                start, step, fired, value = reader.read(own, own_cuts, times[rows], flags, values, None if number is None else number[rows])
                said = {"all": np.ones(len(rows), bool), "windows": start[1], "fired": fired}[tell[c]]
                if not said.any():
                    continue
                told = [
                    pa.array(np.full(said.sum(), c, np.int32)), pa.array(start[0][said], pa.int64(), mask=~start[1][said]).cast(pa.timestamp("us", "UTC")),
                    pa.array(step[0][said], pa.int32(), mask=~step[1][said]), pa.array(fired[said]), pa.array(value[0][said], pa.float64(), mask=~value[1][said]),
                ]
                event = batch.column(0) if said.all() and len(rows) == len(batch) else batch.column(0).take(pa.array(rows[said]))
                yield pa.RecordBatch.from_arrays([event, *told], names=[all_, CHAIN, START, STEP, FIRED, VALUE])

    told = _dealt(df, keys, ts, order, chains, parts, all_).mapInArrow(run, shape)
    return told.select(*[F.col(f"{all_}.{c}") for c in names], CHAIN, START, STEP, FIRED, VALUE)


def _dealt(df: DataFrame, keys: list[str], ts: str, order: str, chains: list[Chain], parts: list[str] | None, all_: str) -> DataFrame:
    """Rows dealt by key and sorted by time, as ``all_`` and what the chains read.

    A distinct value is told by the number of the key's row in which it stood before (-1: in
    none), so neither the values nor a set of them goes to Python. All windows here are of
    one key, so they share its exchange.
    """
    ofs = [F.coalesce(F.expr(" OR ".join(f"({s.when})" for s in c.steps)), F.lit(False)).alias(f"_w{i}") for i, c in enumerate(chains)]
    inputs = [x for i, c in enumerate(chains) for x in inputs_of(list(c.steps), f"{i}_")]
    ready = df.where(F.col(ts).isNotNull()).where(" OR ".join(f"({s.when})" for c in chains for s in c.steps)).select(
        F.struct(*[F.col(c) for c in df.columns]).alias(all_), micros(ts).alias("_t"), F.to_json(F.struct(*keys, *(parts or [])), {"ignoreNullFields": "false"}).alias("_k"), F.col(order).alias("_o"), *ofs, *inputs
    ).repartition("_k")
    of = lambda measure: [f"{c}_{i}_{j}" for c, x in enumerate(chains) for i, s in enumerate(x.steps) for j, t in enumerate(s.thresholds) if t.measure == measure]
    ready = ready.drop(*[f"_v{at}" for at in of("count")])
    if not of("distinct"):
        return ready.sortWithinPartitions("_k", "_t", "_o").drop("_o")
    ready = ready.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("_t", "_o")).cast("long") - 1)
    for at in of("distinct"):
        before = F.lag("_n", 1, -1).over(Window.partitionBy("_k", f"_f{at}", f"_v{at}").orderBy("_n"))
        ready = ready.withColumn(f"_v{at}", F.when(F.col(f"_f{at}") & F.col(f"_v{at}").isNotNull(), before))
    return ready.sortWithinPartitions("_k", "_n").drop("_o")


def slimmed(df: DataFrame, keep: list[str], steps: list[Step]) -> tuple[DataFrame, list[Step]]:
    """Only ``keep`` and what the steps look at, already worked out: Spark cannot prune columns below a Python reader."""
    cols = []

    def short(s: Step, name: str) -> Step:
        at = [unused(keep, f"_{part}{name}") for part in ("when", "of", "guard")]
        if s.either:
            return any_of(*[short(t, f"{name}_{j}") for j, t in enumerate(s.either)])
        cols.extend(
            [F.coalesce(F.expr(s.when), F.lit(False)).alias(at[0]), F.expr(s.of).alias(at[1]), F.coalesce(F.expr(s.guard or "TRUE"), F.lit(False)).alias(at[2])]
        )
        return Step(at[0], s.least, s.measure, at[1], at[2])

    out = [short(s, str(i)) for i, s in enumerate(steps)]
    return df.select(*dict.fromkeys(keep), *cols), out


def _counted(df: DataFrame, keys: list[str], ts: str, order: str, dur: str, step: Step, on_fire: str, parts: list[str] | None, hot: bool) -> DataFrame:
    n, least = F.col("row_in_window"), int(-(-step.least // 1))
    value = n if on_fire == "every" else F.lit(least)
    fired = {"reset": n % least == 0, "once": n == least, "every": n >= least}[on_fire]
    counts = df.where(step.flag)
    rows = anchored(blocks(counts, keys, ts, dur) if hot else counts, keys, ts, order, dur, parts)
    return rows.select(*df.columns, START, F.when(fired, 0).alias(STEP), fired.alias(FIRED), F.when(fired, value.cast("double")).alias(VALUE))


def firings(tracked: DataFrame) -> DataFrame:
    return tracked.where(FIRED)


def with_reason(tracked: DataFrame, dur: str, watermark: DataFrame | None = None, end_reason: str | None = "eos") -> DataFrame:
    """``tracked`` with ``close_reason``: why the row's window closes.

    Windows whose end the watermark (one row, see ``watermark_of``) has passed close by
    timeout, the others for ``end_reason``, or stay open if it is None.
    """
    if watermark is None:
        return tracked.withColumn("close_reason", F.lit(end_reason).cast("string"))
    passed = F.col(START) + F.make_dt_interval(secs=F.lit(seconds(dur))) <= F.col("watermark")
    return tracked.join(F.broadcast(watermark)).withColumn("close_reason", F.when(passed, "timeout").otherwise(F.lit(end_reason))).drop("watermark")


def with_interval(tracked: DataFrame, keys: list[str], ts: str, order: str) -> DataFrame:
    """``tracked`` with ``interval_s``: seconds since the event before in the same window, null for its first."""
    before = F.lag(micros(ts)).over(Window.partitionBy(*keys, START).orderBy(ts, order))
    return tracked.withColumn("interval_s", (micros(ts) - before) / 1e6)


def evidence(tracked: DataFrame, keys: list[str], ts: str, order: str, dur: str, *more: Column) -> DataFrame:
    """One row per window: counts of its events and matches, its first and last event, its bounds, and ``more`` aggregates.

    Of rows with a ``close_reason`` it is told too, and ``more`` may look at it.
    """
    rows = tracked.where(F.col(START).isNotNull())
    at = F.struct(F.col(ts), F.col(order))
    reason = [c for c in ("close_reason",) if c in tracked.columns]
    return rows.groupBy(*keys, START, *reason).agg(
        F.count(F.lit(1)).alias("window_events"), F.count_if(FIRED).alias("matches"), F.max_by(F.when(F.col(FIRED), F.col(VALUE)), F.when(F.col(FIRED), at)).alias("trigger_value"),
        F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), *more,
    ).withColumn("window_end", F.col(START) + F.make_dt_interval(secs=F.lit(seconds(dur))))


def closings(windows: DataFrame, close: Column, last: str = "last_event") -> DataFrame:
    """Windows (``evidence`` of rows ``with_reason``) that close with ``close`` true, with ``fired_at``: their end by timeout, else their last event."""
    at = F.when(F.col("close_reason") == "timeout", F.col("window_end")).otherwise(F.col(last))
    return windows.withColumn("fired_at", at).where(F.col("close_reason").isNotNull() & F.coalesce(close, F.lit(False)))


def watermark_of(df: DataFrame, ts: str, delay: str = "0s") -> DataFrame:
    """One row with the time up to which all events are taken to have arrived."""
    return df.agg((F.max(ts) - F.make_dt_interval(secs=F.lit(seconds(delay)))).alias("watermark"))


def running(df: DataFrame, keys: list[str], ts: str, order: str) -> Window:
    """The frame of a window's rows up to each row, for measures that do not restart; needs ``window_start``."""
    return Window.partitionBy(*keys, START).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
