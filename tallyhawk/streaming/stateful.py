"""Rules on streams: anchored windows, chains of steps and closing conditions in keyed state.

Rows of a micro-batch come in any order and an anchored window depends on order, so rows
wait until the watermark has passed them. Keys are dealt into groups by their hash, and a
group's state is in five parts. ``waiting`` holds the rows of its keys in chunks of
consecutive times, as many rows each as there are chunks and 512 at least; ``chain`` where
the chunks begin and the group's one timer; ``open`` each key's open window, the step under
way and its measures; ``seen`` the distinct values of that step; and ``events``, for rules
with a closing condition, the events of the open windows. In the last two, keys with little
share a record and the others have records of their own. The timer stands at the earliest
waiting row or at the first end of a window, so a micro-batch reads and writes only chunks
with new or due rows, and a group without due rows is not touched. Every call of the state
is a message to the JVM, so a group makes few of them however many its rows and keys: what
begins and ends within one micro-batch is never written. For the same reason rows go to the
operator in bundles of a group's rows, and come from it many in one, in arrays. A group whose
windows are over and that waits for nothing has no state.

Three kinds of rows come out: ``fired`` (a chain is completed), ``window`` (the events of a
window that closes by timeout, all in the batch in which it closes) and ``late`` (rows that
the watermark had passed before they came: a side output, nothing is dropped). The first
two become alerts in ``foreachBatch`` by the same aggregates as in batch.
"""

from __future__ import annotations

import pickle
import tempfile
from bisect import bisect_left, bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, pairwise
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhawk.operators import match
from tallyhawk.operators.match import FIRED, STEP, VALUE, Step, inputs_of, plan_of
from tallyhawk.operators.windows import START, micros, named_apart, seconds
from tallyhawk.plans import rule as rules
from tallyhawk.plans.rule import Rule

KIND = "kind"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_TIME, _BY_TIME = itemgetter(0), itemgetter(0, 1)
#: Rows of a chunk at least, unless a group has fewer, and the most that a group's new rows are in memory.
_LEAST_CHUNK, _MOST_NEW = 512, 16384
#: Events or distinct values of a key up to which they share a record; events, and about as many values, of a record of its own; rows that come out in one.
_FEW, _PIECE, _MOST_OUT = 16, 128, 1024
#: The most rows and bytes that wait to be bundled.
_MOST_BUNDLED, _MOST_BYTES = 131_072, 32_000_000
_SHARED = ("", 0)
_Out = namedtuple("_Out", "kind start step fired value event")
_OUT = "kind array<string>, start array<long>, step array<int>, fired array<boolean>, value array<double>, event array<string>"


@dataclass
class _Group:
    """What of a group of keys is in the state."""

    number: int = 0  # of the next chunk
    wake: int | None = None  # the timer
    until: int | None = None  # first end of an open window
    seen: bool = False  # are there records that keys with few distinct values, or events, share?
    events: bool = False
    chunks: list = field(default_factory=list)  # first time and number of each chunk of waiting rows, in order


@dataclass
class _Window:
    """A key's open window and the step under way in it."""

    start: int
    at: int = 0
    fired: bool = False
    measures: list = field(default_factory=list)  # rows, sum and number of distinct values for each threshold
    words: int = 0  # records of its own with distinct values, and with events
    pieces: int = 0


class _Store:
    """Records of a group by key and number, of which the first is shared by the keys with little."""

    def __init__(self, state, held: bool):
        self.state, self.held = state, held
        self.little = self.get(*_SHARED) if held else {}

    def get(self, k: str, number: int):
        return pickle.loads(bytes(self.state.getValue((k, number))[0]))

    def put(self, k: str, number: int, what) -> None:
        self.state.updateValue((k, number), (pickle.dumps(what),))

    def save(self) -> bool:
        if self.little:
            self.put(*_SHARED, self.little)
        elif self.held:
            self.state.removeKey(_SHARED)
        return bool(self.little)


class _Events(_Store):
    """Events of open windows, in order."""

    def add(self, k: str, o: _Window, event: tuple) -> None:
        rows = self.little.setdefault(k, [])
        rows.append(event)
        if len(rows) == _PIECE:
            self._own(k, o)

    def _own(self, k: str, o: _Window) -> None:
        self.put(k, o.pieces, self.little.pop(k))
        o.pieces += 1

    def taken(self, k: str, o: _Window) -> Iterator[tuple]:
        for number in range(o.pieces):
            yield from self.get(k, number)
            self.state.removeKey((k, number))
        yield from self.little.pop(k, ())

    def save_of(self, windows: dict[str, _Window]) -> bool:
        for k in [k for k, rows in self.little.items() if len(rows) > _FEW]:
            self._own(k, windows[k])
        return self.save()


class _Seen(_Store):
    """Distinct values of the steps under way. A key with many has them in records by hash, four for one when they grow."""

    def __init__(self, state, held: bool):
        super().__init__(state, held)
        self.parts, self.changed = {}, set()

    def new(self, k: str, o: _Window, threshold: int, word: str) -> bool:
        at = (threshold, word)
        if o.words:
            part = (k, _hash(at) % o.words)
            known = self._part(part)
        else:
            known = self.little.setdefault(k, set())
        if at in known:
            return False
        known.add(at)
        if o.words:
            self.changed.add(part)
        return True

    def _part(self, part: tuple[str, int]) -> set:
        if part not in self.parts:
            self.parts[part] = self.get(*part)
        return self.parts[part]

    def clear(self, k: str, o: _Window) -> None:
        self.little.pop(k, None)
        for part in [(k, number) for number in range(o.words)]:
            self.state.removeKey(part)
            self.parts.pop(part, None)
            self.changed.discard(part)
        o.words = 0

    def save_of(self, windows: dict[str, _Window]) -> bool:
        for k in [k for k, known in self.little.items() if len(known) > _FEW]:
            windows[k].words = 1
            self.parts[k, 0] = self.little.pop(k)
            self.changed.add((k, 0))
        for k in {k for k, _ in self.changed}:
            o = windows[k]
            while any(len(self.parts[part]) > 8 * _PIECE for part in self.changed if part[0] == k):
                for number in range(o.words):
                    known, into = self._part((k, number)), 4 * o.words
                    for i in range(number, into, o.words):
                        self.parts[k, i] = {at for at in known if _hash(at) % into == i}
                        self.changed.add((k, i))
                o.words *= 4
        for part in self.changed:
            self.put(*part, self.parts[part])
        return self.save()


def _hash(at: tuple[int, str]) -> int:
    return crc32(f"{at[0]} {at[1]}".encode())


class Follower(StatefulProcessor):
    """State of a group of keys that follow one chain of steps each, see the module. Its own rows are of one key, those of ``_Packed`` of many."""

    def __init__(self, plan: tuple, span: int, on_fire: str, windows: bool):
        self.plan, self.span, self.on_fire, self.windows = plan, span, on_fire, windows
        self.kinds = any(kind == "distinct" for s in plan for kind, _ in s)
        #: Where a waiting row has the flag of each threshold; its value follows. Time, order and event come before, the key comes last.
        self.places, at = [], 3
        for s in plan:
            self.places.append([*range(at, at + 2 * len(s), 2)])
            at += 2 * len(s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chain = handle.getValueState("chain", "number long, wake long, until long, seen boolean, chunks array<struct<first:long,number:long>>, events boolean")
        self.open = handle.getValueState("open", "windows binary")
        self.waiting = handle.getMapState("waiting", "chunk long", "rows binary")
        self.seen = handle.getMapState("seen", "key string, number int", "words binary")
        self.events = handle.getMapState("events", "key string, number int", "rows binary")

    def close(self) -> None:
        pass

    def _load(self) -> _Group:
        number, wake, until, seen, chunks, events = self.chain.get()
        return _Group(number, wake, until, seen, events, [tuple(c) for c in chunks])

    def _save(self, g: _Group) -> None:
        """Put the group's state back, and its timer where it is next due; nothing to wait for is no state."""
        due = [g.chunks[0][0]] if g.chunks else []
        if g.until is not None:
            due.append(g.until)
        wake = -(-min(due) // 1000) if due else None
        if wake != g.wake:
            if g.wake is not None:
                self.handle.deleteTimer(g.wake)
            if wake is not None:
                self.handle.registerTimer(wake)
            g.wake = wake
        if due:
            self.chain.update((g.number, g.wake, g.until, g.seen, g.chunks, g.events))
        else:
            self.chain.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[tuple]:
        columns = ["_t", "_o", "_event", *[f"_{part}{i}_{j}" for i, s in enumerate(self.plan) for j in range(len(s)) for part in "fv"]]
        return self._come(((*[r[c] for c in columns], key[0]) for r in rows), timerValues.getCurrentWatermarkInMs() * 1000)

    def _come(self, rows: Iterator[tuple], upto: int) -> Iterator[tuple]:
        new, g = [], None
        for row in rows:
            if row[0] <= upto:
                yield _Out("late", None, None, False, None, row[2])
                continue
            new.append(row)
            if len(new) == _MOST_NEW:
                g = g or self._known()
                self._put(g, new)
                new = []
        if new:
            g = g or self._known()
            self._put(g, new)
        if g is not None:
            self._save(g)

    def _known(self) -> _Group:
        return self._load() if self.chain.exists() else _Group()

    def _waiting(self, number: int) -> list[tuple]:
        return pickle.loads(bytes(self.waiting.getValue((number,))[0]))

    def _wait(self, number: int, rows: list[tuple]) -> None:
        self.waiting.updateValue((number,), (pickle.dumps(rows),))

    def _put(self, g: _Group, new: list[tuple]) -> None:
        """New rows into the chunks of their times; rows of one time stay together."""
        new.sort(key=_BY_TIME)
        most, chunks, begin = max(_LEAST_CHUNK, len(g.chunks)), [], 0
        ends = [bisect_left(new, first, key=_TIME) for first, _ in g.chunks[1:]] + [len(new)]
        for (first, number), end in zip(g.chunks or [(None, None)], ends, strict=True):
            if end == begin:
                chunks.append((first, number))
                continue
            rows = new[begin:end]
            if number is not None:
                rows = sorted(self._waiting(number) + rows, key=_BY_TIME)
            begin, at = end, 0
            whole = len(rows) <= 2 * most
            while at < len(rows):
                to = len(rows) if whole else min(at + most, len(rows))
                while to < len(rows) and rows[to][0] == rows[to - 1][0]:
                    to += 1
                if number is None:
                    number, g.number = g.number, g.number + 1
                self._wait(number, rows[at:to])
                chunks.append((rows[at][0], number))
                at, number = to, None
        g.chunks = chunks

    def _due(self, g: _Group, upto: int) -> Iterator[tuple]:
        """Waiting rows that the watermark has passed, in order, a chunk at a time; the rest waits on."""
        while g.chunks and g.chunks[0][0] <= upto:
            _, number = g.chunks[0]
            rows = self._waiting(number)
            end = bisect_right(rows, upto, key=_TIME)
            if end < len(rows):
                self._wait(number, rows[end:])
                g.chunks[0] = (rows[end][0], number)
            else:
                self.waiting.removeKey((number,))
                del g.chunks[0]
            yield from rows[:end]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[tuple]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        g = self._load()
        g.wake = None  # Spark takes away the timer that has expired
        windows = {k: _Window(*o) for k, o in pickle.loads(bytes(self.open.get()[0])).items()} if g.until is not None else {}
        seen, kept = _Seen(self.seen, g.seen), _Events(self.events, g.events)
        for row in self._due(g, upto):
            t, event, k = row[0], row[2], row[-1]
            o = windows.get(k)
            if o is not None and t >= o.start + self.span:
                yield from self._closed(k, windows.pop(k), seen, kept)
                o = None
            if o is None:
                if not any(row[i] for i in self.places[0]):
                    continue
                o = windows[k] = _Window(t)
                self._next(k, o, seen, 0)
            step, fired, value = self._feed(k, o, seen, row)
            if fired:
                yield _Out("fired", o.start, step, True, value, event)
            if self.windows:
                kept.add(k, o, (step, fired, value, event))
        for k in [k for k, o in windows.items() if o.start + self.span <= upto]:
            yield from self._closed(k, windows.pop(k), seen, kept)
        g.seen, g.events = seen.save_of(windows), kept.save_of(windows)
        if windows:
            self.open.update((pickle.dumps({k: (o.start, o.at, o.fired, o.measures, o.words, o.pieces) for k, o in windows.items()}),))
        elif g.until is not None:
            self.open.clear()
        g.until = min(o.start for o in windows.values()) + self.span if windows else None
        self._save(g)

    def _closed(self, k: str, o: _Window, seen: _Seen, kept: _Events) -> Iterator[tuple]:
        for step, fired, value, event in kept.taken(k, o):
            yield _Out("window", o.start, step, fired, value, event)
        seen.clear(k, o)

    def _feed(self, k: str, o: _Window, seen: _Seen, row: tuple) -> tuple[int | None, bool, float | None]:
        """(step completed, fires, its measure) of the next row."""
        met = None
        for j, ((kind, least), place) in enumerate(zip(self.plan[o.at], self.places[o.at], strict=True)):
            if not row[place]:
                continue
            n, total, kinds = o.measures[j]
            v = row[place + 1]
            n += 1
            if kind == "distinct":
                kinds += v is not None and seen.new(k, o, j, v)
            elif kind != "count":
                total += v if v is not None and v == v else 0.0
            o.measures[j] = (n, total, kinds)
            measure = float({"count": n, "distinct": kinds, "sum": total}.get(kind, total / n))
            if met is None and measure >= least:
                met = measure
        if met is None:
            return None, False, None
        done, last = o.at, o.at == len(self.plan) - 1
        fires = last and not (self.on_fire == "once" and o.fired)
        o.fired |= last
        if not (last and self.on_fire == "every"):
            self._next(k, o, seen, 0 if last else o.at + 1)
        return done, fires, met

    def _next(self, k: str, o: _Window, seen: _Seen, at: int) -> None:
        o.at, o.measures = at, [(0, 0.0, 0) for _ in self.plan[at]]
        if self.kinds:
            seen.clear(k, o)


class _Packed(Follower):
    """``Follower`` of the keys of a group whose rows come in bundles and go out many in one: a row by itself costs Spark ten times as much as one of an array."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        loose = (row for r in rows for row in zip(*pickle.loads(bytes(r["_rows"])), strict=True))
        return _packed(self._come(loose, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return _packed(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))


def _packed(rows: Iterator[tuple]) -> Iterator[Row]:
    while some := list(islice(rows, _MOST_OUT)):
        yield Row(**dict(zip(_Out._fields, zip(*some, strict=True), strict=True)))


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_group, _rows``: rows of a group, the first column, bundled as lists of the others' values, of so many rows at a time as fit the memory."""
    held, n, size = [], 0, 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n and (batch is None or n >= _MOST_BUNDLED or size >= _MOST_BYTES):
            yield _by_group(pa.Table.from_batches(held))
            held, n, size = [], 0, 0


def _by_group(rows: pa.Table) -> pa.RecordBatch:
    of = rows.column(0).to_numpy()
    order = np.argsort(of, kind="stable")
    of = of[order]
    begins = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
    others = [_values(c) for c in rows.select(rows.column_names[1:]).take(pa.array(order)).columns]
    bundles = [pickle.dumps([c[at:to] for c in others]) for at, to in pairwise([*begins.tolist(), len(of)])]
    return pa.RecordBatch.from_pydict({"_group": of[begins], "_rows": bundles}, pa.schema([("_group", pa.int64()), ("_rows", pa.binary())]))


def _values(column: pa.ChunkedArray) -> list:
    """``to_pylist``, for numbers without null and for texts by way of numpy, which takes a tenth of the time."""
    numbers = any(of(column.type) for of in (pa.types.is_integer, pa.types.is_float32, pa.types.is_float64, pa.types.is_boolean))
    if pa.types.is_string(column.type) or (numbers and not column.null_count):
        return column.to_numpy().tolist()
    return column.to_pylist()


def tracked(
    stream: DataFrame, keys: list[str], ts: str, order: str, dur: str, steps: list[Step], on_fire: str = "reset", windows: bool = False, groups: int = 2048
) -> DataFrame:
    """``kind, <the event's columns>, window_start, step, fired, value``: firings, with ``windows`` the events of windows that close, and late rows.

    ``stream`` needs a watermark on ``ts``; rows without a time or of no step are left out
    (and do not move the watermark). Append mode. State is in RocksDB, which is set for the session if nothing else was. What
    the watermark has not passed at the end of a finite input stays in the state, as windows
    do that end later; a query started again from its checkpoint goes on from there. The keys
    of one of ``groups``, of which there should be several for each shuffle partition and one
    for each few hundred keys, share a state; a checkpoint goes on with the number it began with.
    """
    named_apart(stream.columns, KIND, START, STEP, FIRED, VALUE)
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, _ROCKSDB)
    # Only expressions of the time go on, without the watermark's mark on the column: Spark would drop late rows otherwise.
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    ready = stream.where(F.col(ts).isNotNull()).where(" OR ".join(f"({s.when})" for s in steps)).select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), micros(ts).alias("_t"), F.col(order).alias("_o"),
        F.to_json(F.struct(*stream.columns), _JSON).alias("_event"), *inputs_of(steps), key.alias("_k"),
    ).mapInArrow(_bundled, "_group long, _rows binary")
    follower = _Packed(plan_of(steps), seconds(dur) * 1_000_000, on_fire, windows)
    out = ready.groupBy("_group").transformWithState(follower, _OUT, "append", "eventTime").select(F.inline(F.arrays_zip(*_Out._fields)))
    event = F.from_json("event", T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema]), _JSON)
    return out.withColumn("event", event).select(KIND, "event.*", F.timestamp_micros("start").alias(START), STEP, FIRED, VALUE)


def followed(rule: Rule, stream: DataFrame, ts: str = "ts", order: str = "event_id", groups: int = 2048) -> DataFrame:
    """``tracked`` for a whole rule; ``alerts_of`` makes alerts of its micro-batches."""
    bound, steps = rules.bound(rule, stream, ts, order)
    return tracked(bound, list(rule.keys), ts, order, rule.dur, steps, rule.on_fire, windows=bool(rule.close), groups=groups)


def alerts_of(rule: Rule, batch: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Alerts of a micro-batch of ``followed``, as ``rule.run`` gives them; for ``foreachBatch``. Windows close by timeout only: a stream has no end."""
    windows = batch.where(F.col(KIND) == "window").drop(KIND).withColumn("close_reason", F.lit("timeout"))
    return rules.told(rule, batch.where(F.col(KIND) == "fired").drop(KIND), windows, ts, order)


def late_of(batch: DataFrame) -> DataFrame:
    """Late events of a micro-batch, as they came."""
    return batch.where(F.col(KIND) == "late").drop(KIND, START, STEP, FIRED, VALUE)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local session gets one of its own, and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True, every: str = "10 seconds"):
    """Run a stream into ``each(batch, number)``: all there is now and stop, or on and on at an interval."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    if once:
        query.awaitTermination()
    return query


def revised(batch: DataFrame, keys: list[str], recompute: Callable[[DataFrame], DataFrame], history: DataFrame) -> DataFrame:
    """Late policy *revise*: results of all keys that ``batch`` touches, worked out again on history and batch. For ``foreachBatch``."""
    touched = batch.select(*keys).distinct()
    return recompute(history.join(touched, keys, "left_semi").unionByName(batch))
