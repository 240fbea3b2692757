import hashlib

import numpy as np
import pytest

from tallyhawk.llm import clustering


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], "vec_id long, embedding array<double>, x int, cluster string")
    return sorted(tuple(r) for r in clustering.clustered(df, **options).collect())


def brute(rows, k, rounds, dim, scale, seed):
    kept = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows if v and len(v) == dim and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))
    if not kept:
        return []
    x = np.array([v for _, v in kept])
    c = x[:k].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at, least = d.argmin(axis=1), d.min(axis=1)
        for j in set(at.tolist()) if turn < rounds else ():
            c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)]
    told = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted((i, int(a), int(m), int(least[at == a].sum()), int(least.sum()), told[a]) for (i, _), a, m in zip(kept, at, least, strict=True))


OPTIONS = {"k": 5, "rounds": 4, "dim": 6, "scale": 100, "seed": 3}


@pytest.mark.parametrize("kind", ["normal", "clustered", "copies", "ties"])
def test_equals_lloyd(spark, kind):
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=(600, 6)), "clustered": np.repeat(rng.normal(size=(5, 6)) * 9, 80, axis=0) + rng.normal(size=(400, 6)) / 9,
        "copies": np.repeat(rng.normal(size=(3, 6)), 100, axis=0), "ties": rng.integers(-1, 2, size=(300, 6)) / 50.0,
    }[kind]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    assert run(spark, rows, **OPTIONS) == brute(rows, **OPTIONS)


def test_odd_rows(spark):
    good = [(i, [float(i), 1.0, -2.5, 0.125, 3.0, -0.001]) for i in range(3)]
    rows = [*good, good[0], (5, None), (6, []), (7, [1.0] * 5), (8, [None] + [1.0] * 5), (9, [float("nan")] + [1.0] * 5), (10, [float("-inf")] + [1.0] * 5), (11, [1e30] + [1.0] * 5)]
    assert run(spark, rows, **OPTIONS) == brute(rows[:-1], **OPTIONS)
    assert len(run(spark, rows, **OPTIONS)) == 4 and run(spark, rows[4:], **OPTIONS) == [] and run(spark, [], **OPTIONS) == []


def test_search_skips_what_the_bounds_exclude():
    rng = np.random.default_rng(2)
    c = rng.integers(-900, 900, size=(200, 1)) + rng.integers(-60, 60, size=(200, 16)) * rng.integers(1, 9, size=(200, 1))
    x = c[rng.integers(0, 200, 3000)] + rng.integers(-9, 9, size=(3000, 16))
    total = x.sum(axis=1)
    spread = np.sqrt(((x - (total / 16)[:, None]) ** 2).sum(axis=1))
    at, d, counted = clustering.Search(c).nearest(x, total, spread)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert counted < 0.1 * every.size
