"""Chains of steps read by jumps: from each row to the row that completes a step, not row by row.

For every threshold the rows that count toward it are known in order. A count's completing
row is the n-th next of them. For sums, averages and distinct values the measure over the
first few rows from each start is worked out for all starts of a batch at once; the rare
start that needs more is searched in blocks of doubling length when the chain gets there.
Whether a value is new to a segment shows in where it stood before (``prev``, a row number
that Spark works out): it is, if that lies before the segment's start. So a key needs no
set of values, and what is kept of it from batch to batch is a few numbers.

Sums are added one after the other from a segment's start, as a row-wise reading would.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

#: A value's earlier row where the row counts no value at all.
NOT_NEW = np.iinfo(np.int64).max
_NARROW = 16  # rows from each start that are worked out for all starts
_BLOCK = 64


@dataclass
class Measure:
    """What the rows of a segment so far add up to."""

    n: int = 0
    total: float = 0.0
    kinds: int = 0


class Threshold:
    """The rows of a batch that count toward one threshold, and how far it is from each."""

    def __init__(self, kind: str, least: float, flag: np.ndarray, value: np.ndarray | None, number: np.ndarray):
        self.kind, self.least = kind, least
        self.at = np.nonzero(flag)[0]
        self.before = np.concatenate(([0], np.cumsum(flag))).tolist()  # counting rows before each row
        self.rows = self.at.tolist()
        if kind == "count":
            self.need = max(1, int(-(-least // 1)))
            return
        self.value = value[self.at]
        m = len(self.at)
        fill = np.full(_NARROW, NOT_NEW if kind == "distinct" else np.nan, self.value.dtype)
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.value, fill)), _NARROW)[:m]
        if kind == "distinct":
            measure = np.cumsum(near < number[self.at][:, None], axis=1)
        else:
            measure = np.cumsum(near, axis=1)
            if kind == "avg":
                measure = measure / np.arange(1, _NARROW + 1)
        met = measure >= least
        steps = met.argmax(axis=1)
        every = np.arange(m)
        self.steps = np.where(met[every, steps], steps, -1).tolist()
        self.reached = measure[every, steps].astype(float).tolist()

    def measures(self, low: int, high: int, so_far: Measure, begin: int) -> np.ndarray:
        """The measure after each of the counting rows ``low`` to ``high``, of a segment from row number ``begin``."""
        n = so_far.n + np.arange(1, high - low + 1)
        if self.kind == "count":
            return n.astype(float)
        if self.kind == "distinct":
            return so_far.kinds + np.cumsum(self.value[low:high] < begin).astype(float)
        total = np.cumsum(np.concatenate(([so_far.total], self.value[low:high])))[1:]
        return total if self.kind == "sum" else total / n

    def added(self, low: int, high: int, so_far: Measure, begin: int) -> Measure:
        out = Measure(so_far.n + high - low, so_far.total, so_far.kinds)
        if self.kind == "distinct":
            out.kinds += int((self.value[low:high] < begin).sum())
        elif self.kind != "count" and high > low:
            out.total = float(np.cumsum(np.concatenate(([so_far.total], self.value[low:high])))[-1])
        return out

    def search(self, low: int, high: int, so_far: Measure, begin: int) -> tuple[int, float] | None:
        """The first of the counting rows ``low`` to ``high`` at which the threshold is met, and the measure there."""
        if self.kind == "count":
            place = low + max(0, self.need - so_far.n - 1)
            return (self.rows[place], float(so_far.n + place - low + 1)) if place < high else None
        size = _BLOCK
        while low < high:
            upto = min(low + size, high)
            measure = self.measures(low, upto, so_far, begin)
            met = measure >= self.least
            k = int(met.argmax())
            if met[k]:
                return self.rows[low + k], float(measure[k])
            so_far, low, size = self.added(low, upto, so_far, begin), upto, size * 2
        return None

    def fresh(self, row: int, end: int, begin: int) -> tuple[int, float] | None:
        """``search`` from ``row`` on, before row ``end``, with nothing counted yet."""
        low = self.before[row]
        if low >= len(self.rows) or self.rows[low] >= end:
            return None
        if self.kind == "count":
            place = low + self.need - 1
            return (self.rows[place], float(self.need)) if place < self.before[end] else None
        if (step := self.steps[low]) >= 0:
            place = self.rows[low + step]
            return (place, self.reached[low]) if place < end else None
        if self.before[end] - low <= _NARROW:
            return None
        return self.search(low, self.before[end], Measure(), begin)


@dataclass
class Open:
    """A key between two batches: the next row's number, the open window, the step under way and its measures."""

    rows: int = 0
    start: int | None = None
    at: int = 0
    fired: bool = False
    begin: int = 0
    so_far: list[Measure] = field(default_factory=list)


class Chains:
    """Reads batches of rows sorted by key and time; ``plan`` has (measure, least) of each threshold of each step."""

    def __init__(self, plan: tuple[tuple[tuple[str, float], ...], ...], span: int, on_fire: str):
        self.plan, self.span, self.on_fire, self.last = plan, span, on_fire, len(plan) - 1
        self.key: object = object()
        self.open = Open()

    def read(self, keys: list, cuts: list[int], times: np.ndarray, flags: list[list[np.ndarray]], values: list[list[np.ndarray | None]], number: np.ndarray | None = None):
        """(window start, step, fires, measure) of each row as masked arrays; rows ``cuts[i]`` to ``cuts[i + 1]`` are of key ``keys[i]``.

        ``number`` counts the rows of a key, as ``prev`` does; gaps do not matter. Without it all rows are counted.
        """
        n = len(times)
        if number is None:
            number = np.arange(n) - np.repeat(cuts[:-1], np.diff(cuts))
            number[: cuts[1]] += self.open.rows if keys[0] == self.key else 0
        self.number = number.tolist()
        steps = [
            [Threshold(kind, least, f, v, number) for (kind, least), f, v in zip(s, fs, vs, strict=True)]
            for s, fs, vs in zip(self.plan, flags, values, strict=True)
        ]
        begins = np.where(np.logical_or.reduce(flags[0]), np.arange(n), n)
        opening = [*np.minimum.accumulate(begins[::-1])[::-1].tolist(), n]  # the next row that may open a window
        self.windows, self.done, self.every = [], [], []
        t = times.tolist()
        for key, a, b in zip(keys, cuts[:-1], cuts[1:], strict=True):
            if key != self.key:
                self.key, self.open = key, Open()
            self._key(a, b, t, steps, opening)
        return self._told(n)

    def _key(self, i: int, b: int, t: list[int], steps: list[list[Threshold]], opening: list[int]) -> None:
        o, first = self.open, i
        o.rows = self.number[b - 1] + 1
        while True:
            if o.start is None:
                i = opening[i]
                if i >= b:
                    return
                o.start, o.at, o.fired, o.begin, o.so_far = t[i], 0, False, self.number[i], []
            end = bisect_left(t, o.start + self.span, i, b)
            self.windows.append((i, end, o.start))
            i = self._window(i, end, b, steps)
            if end == b:
                return
            o.start = None
            i = max(end, first)

    def _window(self, i: int, end: int, b: int, steps: list[list[Threshold]]) -> int:
        """Follow the chain through rows ``i`` to ``end`` of the open window."""
        o, last, each = self.open, self.last, self.on_fire == "every"
        while i < end:
            ways = steps[o.at]
            if each and o.at == last:
                self._each(ways, i, end, o)
                break
            found = which = None
            for w in ways:
                if o.so_far:
                    got = w.search(w.before[i], w.before[end], o.so_far[ways.index(w)], o.begin)
                else:
                    got = w.fresh(i, end, o.begin)
                if got and (found is None or got[0] < found):
                    found, which = got
            if found is None:
                break
            fires = o.at == last and not (self.on_fire == "once" and o.fired)
            self.done.append((found, o.at, fires, which))
            o.fired |= o.at == last
            o.at = 0 if o.at == last else o.at + 1
            i = found + 1
            o.begin, o.so_far = self.number[i] if i < b else o.rows, []
        if end == b and i < end:
            ways = steps[o.at]
            held = o.so_far or [Measure() for _ in ways]
            o.so_far = [w.added(w.before[i], w.before[end], m, o.begin) for w, m in zip(ways, held, strict=True)]
        return end

    def _each(self, ways: list[Threshold], i: int, end: int, o: Open) -> None:
        """The last step of a chain that fires on every further row: all rows of the segment whose measure is there."""
        held, taken = o.so_far or [Measure() for _ in ways], set()
        for w, m in zip(ways, held, strict=True):
            low, high = w.before[i], w.before[end]
            measure = w.measures(low, high, m, o.begin)
            for k in np.nonzero(measure >= w.least)[0].tolist():
                if (row := w.rows[low + k]) not in taken:
                    taken.add(row)
                    self.done.append((row, o.at, True, float(measure[k])))

    def _told(self, n: int):
        start, step, fired, value = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n)
        inside, completes = np.zeros(n, bool), np.zeros(n, bool)
        if self.windows:
            first, end, at = (np.array(c, np.int64) for c in zip(*self.windows, strict=True))
            which = np.searchsorted(first, np.arange(n), "right") - 1
            inside = (which >= 0) & (np.arange(n) < end[which])
            start = at[which]
        if self.done:
            row, steps, fires, measure = zip(*self.done, strict=True)
            row = np.array(row)
            step[row], fired[row], value[row], completes[row] = steps, fires, measure, True
        return (start, inside), (step, completes), fired, (value, completes)
