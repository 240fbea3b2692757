"""Time windows of keyed events: anchored, fixed, session and trailing.

An anchored window belongs to one key: its first event opens it at t0, it takes the events
before t0 + dur, and the next event opens another. Whether a row opens one depends on the
rows before it, so the rows are dealt by key, sorted by time, and read once in Arrow
batches; what goes from batch to batch is the key and start of the open window, so memory
does not grow with a key's rows. A gap of at least ``dur`` closes any window, which is why
``parts`` may deal the stretches between such gaps to different tasks. A key that never
pauses is cut into ``blocks``, whose windows open on entry are found beforehand.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, ROW = "window_start", "row_in_window"
#: Columns of ``blocks``: the block, the start of the window open as it begins, and the rows that window has before.
BLOCK = PART, OPENED, BEFORE = "_block", "_opened", "_before"


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def seconds(text: str) -> int:
    """Seconds of ``30s``, ``5m``, ``2h``, ``1d``."""
    return int(text[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[text[-1]]


def unused(columns: list[str], name: str) -> str:
    """``name``, or it with underscores added until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named_apart(columns: list[str], *names: str) -> None:
    """An error if a result's column has the name of an event's."""
    if clash := {c.lower() for c in columns} & set(names):
        raise ValueError(f"rename the event columns {sorted(clash)}: the result has columns of these names")


def runs(column: pa.Array) -> tuple[list, list[int]]:
    """Values of each run of equal ones, and where the runs begin, with the end."""
    n = len(column)
    change = np.nonzero(pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False))[0] + 1
    cuts = [0, *change.tolist(), n]
    return column.take(pa.array(cuts[:-1])).to_pylist(), cuts


def stretches(df: DataFrame, keys: list[str], ts: str, dur: str, out: str) -> DataFrame:
    """``df`` with a number per key that rises wherever a whole slot of length ``dur`` has no event.

    Such a gap closes every anchored window. Only the occupied slots of a key meet in one
    task, not its rows.
    """
    slot = F.floor(micros(ts) / (seconds(dur) * 1_000_000))
    slots = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], slot.alias("_slot")).distinct()
    order = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_slot")
    cut = F.coalesce((F.col("_slot") - F.lag("_slot").over(order) > 1).cast("int"), F.lit(0))
    numbered = slots.withColumn("_cut", cut).withColumn(out, F.sum("_cut").over(order))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [slot == F.col("_slot")]
    return df.join(numbered, on).select(*df.columns, out)


_MAP = "_rows bigint, _after array<bigint>, _start array<bigint>, _count array<bigint>"


def _block_map(dur: int):
    """What a block does to the window open on its entry.

    An open window matters only through the block's first row past its end, which opens the
    next. Windows that begin at different rows soon run into each other, so few rows are left
    that the block's last window can begin at. Told are, for each of these, the latest such
    first row that leads to it, its time, and how many rows of the block it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for times in batch.column("_times").to_pylist():
                t = np.array([r["t"] for r in times], np.int64)
                rows = np.concatenate(([0], np.cumsum([r["n"] for r in times])))
                after = np.searchsorted(t, t + dur)
                last = np.arange(len(t))
                for k in range(len(t) - 1, -1, -1):
                    if after[k] < len(t):
                        last[k] = last[after[k]]
                end = np.nonzero(np.append(last[1:] != last[:-1], True))[0]
                out.append((int(rows[-1]), t[end].tolist(), t[last[end]].tolist(), (rows[-1] - rows[last[end]]).tolist()))
            if out:
                told = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), *[pa.list_(pa.int64())] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_times"), *told], names=[*(c for c in batch.schema.names if c != "_times"), "_rows", "_after", "_start", "_count"])

    return run


def _entries(dur: int, names: list[str]):
    """The window open on each block's entry, by its maps in order; of a key only that window is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, count = object(), None, 0
        for batch in batches:
            opened, counts = [], []
            for own, rows, after, starts, had in zip(*(batch.column(c).to_pylist() for c in ("_k", "_rows", "_after", "_start", "_count")), strict=True):
                if own != key:
                    key, start, count = own, None, 0
                opened.append(start)
                counts.append(count)
                at = 0 if start is None else bisect_left(after, start + dur)
                if at < len(after):
                    start, count = starts[at], had[at]
                else:
                    count += rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(opened, pa.int64()), pa.array(counts, pa.int64())], names=[*names, OPENED, BEFORE])

    return run


def blocks(df: DataFrame, keys: list[str], ts: str, dur: str, length: str | None = None, most: int = 100_000) -> DataFrame:
    """``df`` with the columns ``BLOCK``: a number of its key's stretch of ``length``, and the window that is open as the stretch begins.

    For keys of very many rows that never pause: with these columns ``anchored`` deals every
    block by itself. Each block is first told as a map from the window open on entry to that
    open on exit (a row a block), and the maps of a key are followed in order, so no task
    reads a key's rows. Without ``length`` it is chosen so that the fullest block has about
    ``most`` rows (more, if one instant has more).
    """
    named_apart(df.columns, *(c.lower() for c in BLOCK))
    span, own = seconds(dur) * 1_000_000, [f"_k{i}" for i in range(len(keys))]
    timed = df.where(F.col(ts).isNotNull())
    if length is None:
        fullest = timed.groupBy(*keys, F.floor(micros(ts) / span)).count().agg(F.max("count")).head()[0] or 1
        step = max(1, span * most // fullest)
    else:
        step = seconds(length) * 1_000_000
    at = F.floor(micros(ts) / step)
    told = timed.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], at.alias("_at"), micros(ts).alias("t"))
    times = told.groupBy(*own, "_at", "t").agg(F.count(F.lit(1)).alias("n")).groupBy(*own, "_at").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("_times"))
    shape = [*times.drop("_times").schema.fields]
    maps = times.mapInArrow(_block_map(span), T.StructType([*shape, *T.StructType.fromDDL(_MAP).fields]))
    keyed = maps.withColumn("_k", F.to_json(F.struct(*own), {"ignoreNullFields": "false"})).repartition("_k").sortWithinPartitions("_k", "_at")
    names = [f.name for f in shape]
    entered = keyed.mapInArrow(_entries(span, names), T.StructType([*shape, T.StructField(OPENED, T.LongType()), T.StructField(BEFORE, T.LongType())]))
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)] + [at == F.col("_at")]
    return timed.join(entered, on).select(*df.columns, F.col("_at").alias(PART), OPENED, BEFORE)


def _starts(dur: int):
    """Opening rows within one key's sorted times, given the open window's start or None."""

    def run(times: np.ndarray, open_: int | None) -> tuple[np.ndarray, np.ndarray]:
        start = np.empty(len(times), np.int64)
        first = np.empty(len(times), np.int64)
        at = 0
        if open_ is not None:
            at = int(np.searchsorted(times, open_ + dur))
            start[:at], first[:at] = open_, -1
        while at < len(times):
            end = int(np.searchsorted(times, times[at] + dur))
            start[at:end], first[at:end] = times[at], at
            at = end
        return start, first

    return run


def anchored(df: DataFrame, keys: list[str], ts: str, order: str, dur: str, parts: list[str] | None = None) -> DataFrame:
    """``df`` with ``window_start`` and ``row_in_window`` (from 1) of each row's anchored window.

    Rows of equal time go by ``order``. Null keys form a key of their own; rows without a
    time are left out. ``parts`` are columns of ``stretches`` to deal by as well as the keys;
    the columns of ``blocks``, if ``df`` has them, are dealt by, too, and left out of the result.
    """
    named_apart(df.columns, START, ROW)
    span = seconds(dur) * 1_000_000
    in_blocks = set(BLOCK) <= set(df.columns)
    own = df.drop(*BLOCK) if in_blocks else df
    names, all_ = own.columns, unused(own.columns, "_row")
    # The event's own columns travel as one struct, so none can clash with those added here.
    kinds = T.StructType([T.StructField(all_, own.schema), T.StructField(START, T.TimestampType()), T.StructField(ROW, T.LongType())])
    starts = _starts(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, rows = object(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            times = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            own_keys, cuts = runs(batch.column(2))
            start, number = np.empty(n, np.int64), np.empty(n, np.int64)
            for own_key, s, e in zip(own_keys, cuts[:-1], cuts[1:], strict=True):
                if own_key != key:
                    key, open_, rows = own_key, None, 0
                    if in_blocks:
                        open_, rows = batch.column(3)[s].as_py(), batch.column(4)[s].as_py()
                own, first = starts(times[s:e], open_)
                place = np.where(first < 0, rows + np.arange(1, e - s + 1), np.arange(e - s) - first + 1)
                start[s:e], number[s:e] = own, place
                open_, rows = int(own[-1]), int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start, pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(number)], names=[all_, START, ROW])

    deal = [*keys, *(parts or []), *([PART] if in_blocks else [])]
    ready = df.where(F.col(ts).isNotNull()).select(
        F.struct(*[F.col(c) for c in names]).alias(all_), micros(ts).alias("_t"), F.to_json(F.struct(*deal), {"ignoreNullFields": "false"}).alias("_k"),
        *([OPENED, BEFORE] if in_blocks else []), F.col(order).alias("_o"),
    )
    told = ready.repartition("_k").sortWithinPartitions("_k", "_t", "_o").drop("_o").mapInArrow(run, kinds)
    return told.select(*[F.col(f"{all_}.{c}") for c in names], START, ROW)


def fixed(df: DataFrame, ts: str, dur: str) -> DataFrame:
    """``df`` with the epoch-aligned window that each row falls into."""
    return df.withColumn(START, F.window(ts, f"{seconds(dur)} seconds")["start"])


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, *aggregates: Column) -> DataFrame:
    """Per key and session (rows less than ``gap`` apart): its start, its end (last row plus gap) and aggregates."""
    s = F.session_window(ts, f"{seconds(gap)} seconds")
    out = df.groupBy(*keys, s.alias("s")).agg(*aggregates)
    return out.select(*keys, F.col("s.start").alias(START), F.col("s.end").alias("window_end"), *[c for c in out.columns if c not in (*keys, "s")])


def trailing(keys: list[str], ts: str, dur: str):
    """The frame of a key's rows in the ``dur`` up to and including each row's time."""
    return Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-seconds(dur) * 1_000_000, 0)


def trailing_counts(df: DataFrame, keys: list[str], ts: str, dur: str, count: str = "n", **distinct: str) -> DataFrame:
    """``df`` with the number of a key's rows in the ``dur`` up to and including each row's time, and of distinct values of expressions.

    ``distinct`` names each result and gives its expression; nulls are no value. Every row
    enters at its time and leaves ``dur`` later, and a value enters where it did not stand
    within ``dur`` before, and leaves where it does not within ``dur`` after, so the counts
    are running sums: linear in the rows, however many a frame has. One shuffle by key.
    Rows without a time are left out.
    """
    named_apart(df.columns, count.lower(), *(c.lower() for c in distinct))
    span, all_ = seconds(dur) * 1_000_000, unused(df.columns, "_row")
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(ts).isNotNull()).repartition(*keys).select(
        F.struct(*[F.col(c) for c in df.columns]).alias(all_), *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], micros(ts).alias("_t"),
        *[F.expr(e).alias(f"_v{i}") for i, e in enumerate(distinct.values())],
    )
    enters, leaves = [F.lit(1).alias("_c")], [F.lit(-1).alias("_c")]
    for i in range(len(distinct)):
        same, v = Window.partitionBy(*own, f"_v{i}").orderBy("_t"), F.col(f"_v{i}").isNotNull()
        first = F.coalesce(F.col("_t") - F.lag("_t").over(same) > span, F.lit(True))
        last = F.coalesce(F.lead("_t").over(same) - F.col("_t") > span, F.lit(True))
        rows = rows.withColumn(f"_in{i}", (v & first).cast("int")).withColumn(f"_out{i}", (v & last).cast("int"))
        enters.append(F.col(f"_in{i}").alias(f"_d{i}"))
        leaves.append((-F.col(f"_out{i}")).alias(f"_d{i}"))
    marks = F.array(F.struct(F.col("_t").alias("_at"), F.col(all_).alias("_own"), *enters), F.struct((F.col("_t") + span + 1).alias("_at"), F.lit(None).cast(df.schema).alias("_own"), *leaves))
    upto = Window.partitionBy(*own).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.select(*own, F.explode(marks).alias("_m")).select(*own, "_m.*")
    sums = [F.sum("_c").over(upto).alias(count), *[F.sum(f"_d{i}").over(upto).alias(c) for i, c in enumerate(distinct)]]
    return told.select("_own", *sums).where(F.col("_own").isNotNull()).select("_own.*", count, *distinct)
