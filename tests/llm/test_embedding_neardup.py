import numpy as np

from tallyhawk.llm import embedding_neardup as near

SCHEMA = "vec_id long, embedding array<float>, label int, id long"


def brute(rows, threshold=0.95):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {k: [m for m in good if k in good and m != k and good[k] @ good[m] / np.linalg.norm(good[k]) / np.linalg.norm(good[m]) >= threshold] for k in range(len(rows))}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min(rows[m][0] for m in seen)
        out.append((i, len(links[k]), least, i == least))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in near.near_duplicates(df, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 90)
    monkeypatch.setattr(near, "_TILE", 40)
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(12, 40))
    for i in range(360):
        v = base[i % 12] + rng.normal(size=40) * rng.choice([0.05, 0.2, 0.33, 2.0])
        rows.append((1000 - i, v.astype(np.float32).astype(float).tolist()))
    rows += [(2000 + k, rows[3][1]) for k in range(5)] + [(2010, [2 * x for x in rows[4][1]])]
    rows += [(1, None), (2, [0.0] * 40), (3, [float("nan")] + [1.0] * 39), (4, [None] + [1.0] * 39), (5, [float("inf")] + [1.0] * 39), (6, []), (7, [1.0])]
    want = brute([r if r[0] != 7 else (7, None) for r in rows])
    assert run(spark, rows) == want


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[rng.permutation(150)] + rng.normal(size=(150, 64)) * 0.04
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for least in (0.2, 0.9, 0.95):
        i, j = near._tile_pairs(x, y, least)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*[k.tolist() for k in np.nonzero(x @ y.T >= least)]))


def test_none_and_all_unusable(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, None), (4, [0.0, 0.0])]) == [(3, 0, 3, True), (4, 0, 4, True)]
    assert run(spark, [(3, [1.0, 0.0]), (3, [1.0, 0.0])]) == [(3, 1, 3, True)] * 2
