"""The keyed state of a stream: how often it is asked, and what is left in it."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row

from tallyhawk.streaming import stateful
from tallyhawk.streaming.stateful import Follower


class Kept:
    """A state variable of one key; every call is counted."""

    def __init__(self, calls):
        self.calls, self.data = calls, None

    def __getattribute__(self, name):
        if name not in ("calls", "data", "__class__"):
            self.calls[name] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.data)

    def clear(self):
        self.data = None


class Value(Kept):
    def get(self):
        return self.data

    def update(self, value):
        self.data = value


class Map(Kept):
    def getValue(self, key):
        return self.data[key]

    def updateValue(self, key, value):
        self.data = {**(self.data or {}), key: value}

    def containsKey(self, key):
        return key in (self.data or {})

    def removeKey(self, key):
        del self.data[key]


class Listed(Kept):
    def get(self):
        return iter(self.data)

    def appendList(self, rows):
        self.data = [*(self.data or ()), *rows]


class Handle:
    def __init__(self):
        self.calls, self.timers, self.states = Counter(), set(), {}

    def getValueState(self, name, shape):
        return self.states.setdefault(name, Value(self.calls))

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map(self.calls))

    def getListState(self, name, shape):
        return self.states.setdefault(name, Listed(self.calls))

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["deleteTimer"] += 1
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def followed(plan, span, windows=False):
    one, handle = Follower(plan, span, "reset", windows), Handle()
    one.init(handle)
    return one, handle


def come(one, rows, mark):
    return list(one.handleInputRows(("k",), iter([Row(_t=t, _o=o, _event=f"{t}/{o}", _f0_0=True, _v0_0=v) for t, o, v in rows]), Mark(mark)))


def wake(one, handle, mark):
    """Timers that the watermark has passed, as Spark hands them out."""
    out = []
    for at in sorted(t for t in handle.timers if t <= mark):
        handle.calls["timer"] += 1
        out += list(one.handleExpiredTimer(("k",), Mark(mark), None))
        handle.timers.discard(at)
    return out


HOUR = 3_600_000_000


def test_a_key_asks_its_state_a_few_times_however_its_rows_lie():
    """Seventy rows over thirty days, three different values a firing: one chunk and one timer, and no value is written that a firing ends."""
    one, handle = followed(((("distinct", 3),),), 72 * HOUR)
    come(one, [(i * 10 * HOUR + 1000, i, str(i % 5)) for i in range(1, 71)], 0)
    out = wake(one, handle, 71 * 10 * 3_600_000)
    assert len(out) > 15 and len(handle.timers) <= 1
    assert sum(handle.calls.values()) <= 20


def test_a_key_that_is_over_leaves_nothing():
    one, handle = followed(((("distinct", 9),),), HOUR, windows=True)
    come(one, [(1000 * i, i, str(i)) for i in range(1, 6)], 0)
    assert wake(one, handle, 3) == []
    assert handle.states["seen"].data and handle.states["events"].data
    assert [r.event for r in wake(one, handle, 5_000_000)] == [f"{1000 * i}/{i}" for i in range(1, 6)]
    assert not handle.timers and not any(s.data for s in handle.states.values())


@pytest.mark.parametrize("seed", range(3))
def test_rows_of_many_batches_leave_their_chunks_in_order(monkeypatch, seed):
    """One hot key, rows and equal times across chunks, watermarks in between: each row once, in order of time and id."""
    monkeypatch.setattr(stateful, "_LEAST_CHUNK", 4)
    monkeypatch.setattr(stateful, "_MOST_NEW", 7)
    rng, mark, out, given = random.Random(seed), 0, [], []
    one, handle = followed(((("count", 1),),), HOUR)
    for batch in range(30):
        rows = [(mark * 1000 + 1 + rng.randrange(60) * 500, 100 * batch + i, None) for i in range(rng.randrange(40))]
        given += rows
        assert come(one, rows, mark) == []
        firsts = [first for first, _ in handle.states["chain"].data[4]]
        assert firsts == sorted(set(firsts)) and len(handle.timers) == 1
        mark += rng.randrange(12)
        out += [r.event for r in wake(one, handle, mark)]
    out += [r.event for r in wake(one, handle, mark + 1000)]
    assert out == [f"{t}/{o}" for t, o, _ in sorted(given, key=lambda r: r[:2])]
    assert handle.states["waiting"].data == {}
