"""Keys of a stream that share a state: as each key by itself, in a few calls, and with nothing left behind."""

import pickle
import random
import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_stream_state import HOUR, Handle, Mark, wake

from tallyhawk.operators.match import Step
from tallyhawk.streaming import lateness, stateful


def shared(plan, span, windows=False):
    one, handle = stateful._Packed(plan, span, "reset", windows), Handle()
    one.init(handle)
    return one, handle


def bundles(rows):
    """Rows (time, order, value, key) in two Arrow batches, as bundles of group 0."""
    out = []
    for part in (rows[::2], rows[1::2]):
        of = {"_group": [0] * len(part), "_t": [r[0] for r in part], "_o": [r[1] for r in part], "_event": [f"{r[3]}/{r[1]}" for r in part]}
        out.append(pa.RecordBatch.from_pydict(of | {"_f0_0": [True] * len(part), "_v0_0": [r[2] for r in part], "_k": [r[3] for r in part]}))
    for batch in stateful._bundled(iter(out)):
        assert batch.schema.names == ["_group", "_rows"]
        yield from (Row(**r) for r in batch.to_pylist())


def come(one, rows, mark):
    return list(one.handleInputRows((0,), bundles(rows), Mark(mark)))


def loose(rows):
    return [stateful._Out(*r) for many in rows for r in zip(*(many[c] for c in stateful._Out._fields), strict=True)]


def plain(rows, least, span):
    """(kind, window's start, fired, event) of one key's rows: windows of ``span``, a firing at each ``least`` distinct values."""
    out, start, kept, known = [], None, [], set()
    for t, o, v, k in [*sorted(rows), (10**18, 0, "", "")]:
        if start is None or t >= start + span:
            out += [("window", start, *r) for r in kept]
            start, kept, known = t, [], set()
        known.add(v)
        fires = len(known) >= least
        if fires:
            out, known = [*out, ("fired", start, True, f"{k}/{o}")], set()
        kept.append((fires, f"{k}/{o}"))
    return out


@pytest.mark.parametrize("seed,least", [(0, 3), (1, 30), (2, 70)])
def test_keys_of_a_group_are_as_by_themselves(monkeypatch, seed, least):
    """Small and large keys, whose values and events share records or have their own, over many batches and watermarks."""
    for name, value in {"_LEAST_CHUNK": 8, "_MOST_NEW": 50, "_FEW": 2, "_PIECE": 4, "_MOST_OUT": 7, "_MOST_BUNDLED": 20}.items():
        monkeypatch.setattr(stateful, name, value)
    rng, mark, given, out = random.Random(seed), 0, [], []
    one, handle = shared(((("distinct", least),),), HOUR, windows=True)
    for batch in range(40):
        rows = [(mark * 1000 + 1 + rng.randrange(3000) * 500_000, 1000 * batch + i, str(rng.randrange(90)), rng.choice("aaaaaaaabbcdefgh")) for i in range(rng.randrange(90))]
        given += rows
        assert come(one, rows, mark) == []
        assert len(handle.timers) <= 1
        mark += rng.randrange(600_000)
        out += loose(wake(one, handle, mark))
    out += loose(wake(one, handle, mark + 10 * 3_600_000))
    want = [r for k in "abcdefgh" for r in plain([g for g in given if g[3] == k], least, HOUR)]
    assert sorted((r.kind, r.start, r.fired, r.event) for r in out) == sorted(want)
    assert len({r.start for r in out}) > 8 and any(r.kind == "fired" for r in out)
    assert not handle.timers and not any(s.data for s in handle.states.values())


def test_a_group_asks_its_state_a_few_times_however_many_its_keys():
    one, handle = shared(((("distinct", 9),),), 72 * HOUR, windows=True)
    come(one, [(i * HOUR // 9 + 1, i, str(i), f"k{i % 150}") for i in range(450)], 0)
    assert wake(one, handle, 51 * 3_600_000) == []
    assert len(loose(wake(one, handle, 200 * 3_600_000))) == 450
    assert sum(handle.calls.values()) <= 35 and not any(s.data for s in handle.states.values())


def test_late_rows_of_a_bundle_come_out():
    one, handle = shared(((("count", 1),),), HOUR)
    assert [r.event for r in loose(come(one, [(5000, 1, None, "a"), (9000, 2, None, "b"), (5001, 3, None, "b")], 6))] == ["a/1", "b/3"]
    assert [(r.kind, r.event) for r in loose(wake(one, handle, 10))] == [("fired", "b/2")]


def test_a_stream_writes_less_than_its_keys(spark, tmp_path):
    path, got = str(tmp_path / "in"), []
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.range(8000).select(F.col("id").alias("event_id"), (F.lit(t0) + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.concat(F.lit("k"), "id").alias("k"))
    rows.coalesce(1).write.parquet(path)
    read = lateness.watermarked(spark.readStream.schema(rows.schema).parquet(path), "ts", "1m")
    query = stateful.drain(stateful.tracked(read, ["k"], "ts", "event_id", "5m", [Step("TRUE", 1)]), str(tmp_path / "cp"), lambda batch, _: got.extend(r.event_id for r in batch.collect()))
    assert query.recentProgress[0].stateOperators[0].numRowsUpdated < 2 * 8000
    assert sorted(got) == [i for i in range(8000) if t0 + timedelta(seconds=i) <= t0 + timedelta(seconds=7999 - 60)]


def test_bundles_hold_every_value_as_it_is():
    """Numbers, texts and times with and without null, in batches of which some are empty, come back by group."""
    rng, t0 = random.Random(5), datetime(2024, 1, 1)
    rows = [(rng.randrange(9), i, 2**62 + i, rng.choice([None, "", "é\U0001f600", "a"]), i % 2 == 0, rng.choice([None, True]), rng.choice([None, 1.5, -0.0]), i / 3, t0 + timedelta(microseconds=i), Decimal(i).scaleb(-2), rng.choice([None, i])) for i in range(300)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.timestamp("us"), pa.decimal128(20, 2), pa.int32()]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], kind) for c, kind in enumerate(kinds)], [f"c{c}" for c in range(len(kinds))])
    got = [r for out in stateful._bundled(iter([batch(rows[:0]), batch(rows[:170]), batch(rows[:0]), batch(rows[170:])])) for r in out.to_pylist()]
    assert [r["_group"] for r in got] == list(range(9))
    back = [(r["_group"], *row) for r in got for row in zip(*pickle.loads(r["_rows"]), strict=True)]
    assert repr(back) == repr(sorted(rows, key=lambda r: r[:2]))
    assert list(stateful._bundled(iter([]))) == [] and list(stateful._bundled(iter([batch([])]))) == []


def test_bundling_takes_less_time_than_a_python_value_for_each_cell():
    n = 40_000
    cells = {"_group": [i * 7919 % 2048 for i in range(n)], "_t": [*range(n)], "_o": [*range(n)], "_event": [f'{{"event_id": {i}}}' for i in range(n)], "_f0_0": [True] * n, "_v0_0": [1.0] * n, "_k": [f"k{i % 999}" for i in range(n)]}
    batch = pa.RecordBatch.from_pydict(cells)

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    bundling, cell_by_cell = (min(took(f) for _ in range(3)) for f in (lambda: list(stateful._bundled(iter([batch]))), batch.to_pydict))
    assert bundling < cell_by_cell
