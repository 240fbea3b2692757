import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhawk.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, score double"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA)
    return [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **options).collect()]


def brute(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == len(rows[0][1])}
    out = {}
    for q in good:
        if q % 20 == 0:
            out[q] = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
    return out


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 400)
    monkeypatch.setattr(ann, "BLOCK", 30)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.5, 2)).astype(np.float32).astype(float).tolist()) for i in range(1500)]
    rows[40] = (40, [4 * x for x in rows[40][1]])
    rows += [(2000 + i, rows[40][1]) for i in range(60)] + [(3000, None), (3020, [0.0] * 24), (3040, [float("nan")] * 24), (3060, [1.0]), (3080, [])]
    rows.append(rows[40])
    got = run(spark, rows)
    by = {}
    for q, r, i, s in sorted(got):
        by.setdefault(q, []).append((r, i, s))
    want = brute(rows, 20)
    assert by.keys() == want.keys()
    hits = 0
    for q, found in by.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [i for _, i, _ in by[2000]][:5] == [40, 2001, 2002, 2003, 2004]


def test_few_rows_give_all(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [-1.0, 1.0])]
    assert sorted(run(spark, rows)) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0)]
    assert run(spark, []) == [] and run(spark, [(20, None)]) == [] and run(spark, [(20, [1.0])]) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_driver_s_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    got = {}
    for r in queries.op4_prefix_forest(spark, path).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_clustered_vectors_stop_deep():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 64))[rng.integers(0, 160, 16_000)] + 0.3 * rng.normal(size=(16_000, 64))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    planes = ann.planes(64, 48, 17)
    keys = ann.hash_strings(np.hstack([x / length.max(), np.sqrt(np.maximum(0, 1 - (length / length.max()) ** 2))]), planes)
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
    shard = ann.Shard(np.take_along_axis(keys, order, axis=1), order, x, length.max())
    asks = x[::100]
    asked = ann.hash_strings(np.hstack([asks / length[::100], np.zeros((len(asks), 1))]), planes)
    hits = scored = 0
    for (found, score), all_ in zip(shard.search(asked, asks, 21, 0.1), asks @ x.T, strict=True):
        scored += len(found)
        hits += len(set(found[np.argsort(-score)[:21]].tolist()) & set(np.argsort(-all_)[:21].tolist()))
    assert hits >= 0.9 * 21 * len(asks) and scored < 0.25 * len(x) * len(asks)
