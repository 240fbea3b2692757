import random

import numpy as np
import pytest

import corpus_pipeline

from tallyhawk.llm import simhash_confirmed as sc


def slow_set(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def slow_kept(rows):
    sets = {i: slow_set(t) for i, t in rows}
    linked = lambda a, b: sets[a] == sets[b] or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    kept, left = [], sorted(sets)
    while left:
        todo, left = [left[0]], left[1:]
        kept.append(todo[0])
        while todo:
            x = todo.pop()
            near = [y for y in left if linked(x, y)]
            left = [y for y in left if y not in near]
            todo += near
    return kept


def corpus(edge=20):
    rnd = random.Random(4)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, bases = [], [fresh(n) for n in (60, 100, 200, 400, 200, 80)]
    for i in range(240):
        words = list(bases[i % 6])
        for _ in range(rnd.randrange(len(words) // edge)):
            words[rnd.randrange(len(words))] = "other"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(fresh(rnd.choice([1, 3, 5, 40])))) for i in range(40)]
    return rows + [(400, None), (401, ""), (402, " \n"), (403, rows[0][1].upper()), (404, "one two"), (405, "One  two")]


def test_stage_keeps_one_of_each_group_as_a_full_comparison_does(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == slow_kept(rows)


@pytest.mark.parametrize("chunk, dense", [(512, 0), (16, 0)])
def test_chunks_and_opened_buckets_lose_nothing(spark, monkeypatch, chunk, dense):
    monkeypatch.setattr(sc, "CHUNK", chunk)
    monkeypatch.setattr(sc, "_DENSE", dense)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in sc.groups(docs).collect()}
    assert sorted({c for _, c in got}) == slow_kept(rows) and len(got) == len(rows)


def test_share_of_links_proposed():
    """The tables may miss a pair near 0.8; on average over such pairs under one in a hundred."""
    rows = corpus(16)[:240]
    sets = [sc.shingle_set(t.encode()) for _, t in rows]
    fps = [sc.fingerprint_of(s, sc.WORDS) for s in sets]
    nibble = lambda f, p: int(f[p // 16]) >> 4 * (p % 16) & 15
    keys = sc.buckets(np.array(fps)).tolist()
    assert keys[7] == [int(f"{t:x}" + "".join(f"{nibble(fps[7], p):x}" for p in ps), 16) for t, ps in enumerate(sc._NIBBLES.tolist())]
    found = links = 0
    for i in range(240):
        for k in range(i + 6, 240, 6):
            both = len(np.intersect1d(sets[i], sets[k]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[k]) - both):
                links += 1
                far = sum((int(a) ^ int(b)).bit_count() for a, b in zip(fps[i], fps[k], strict=True))
                found += far <= sc.RADIUS and any(a == b for a, b in zip(keys[i], keys[k], strict=True))
    assert links > 400 and found >= 0.99 * links


def test_best_linked_neighbour():
    i, j = np.array([0, 0, 0, 1, 4]), np.array([1, 2, 3, 2, 5])
    at, best = sc._best_linked(i, j, 7)
    assert dict(zip(at.tolist(), best.tolist(), strict=True)) == {1: 0, 2: 0, 3: 0, 5: 4}


def test_ids_that_repeat_or_are_null(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in sc.keep_one(docs).collect()) == [0, 1, 3]
    assert sc.keep_one(docs.limit(0)).count() == 0 and sc.groups(docs.limit(0)).count() == 0


def test_differing_rows_of_one_id_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, "x"), (1, "quite another text here now", 5, "x"), (1, "a b c d e f", 6, "y"), (2, "A B c d e f", 7, None), (4, "", 1, "z"), (3, "", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, row_hash string")
    got = sc.keep_one(docs)
    assert got.columns == docs.columns
    found = sorted((r.doc_id, r.text) for r in got.collect())
    assert found == [(1, "a b c d e f"), (1, "quite another text here now"), (3, "")]
