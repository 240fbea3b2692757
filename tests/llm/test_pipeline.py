"""The pipeline's stages against plain versions, and the queries' result columns."""

import random
import re
import zlib

import corpus_pipeline
import pytest

from tallyhawk.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "in", "er", "ti", "on"]) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(120)]
        toxic = i % 6 == 0
        if toxic:
            words[50:50] = ["gorv" + word(), "blask" + word(), "gorv" + word()]
        docs.append([i, " ".join(words), rnd.choice(["en", "de"]), f"src{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(240, 250):  # near copies of clean documents
        base = docs[(i - 240) * 6 + 1][1].split()
        base[5] = "other"
        docs.append([i, " ".join(base), "en", "src0", 0])
    private = " ".join(word() for _ in range(150)) + " a@b.cd or 10.0.0.1 or 4111 1111 1111 1111 on"
    docs += [[250, docs[1][1], "en", "src1", 0], [251, None, "en", None, 0], [252, private, None, "src2", 0], [252, private, None, "src2", 0]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
        assert docs.columns == COLUMNS
        steps[name] = [tuple(r) for r in docs.collect()]
    left = {r[0] for r in steps["toxicity"]}
    toxic = {i for i in left if i % 6 == 0 and i < 240}
    assert len(toxic) <= 12 and len(left - toxic) >= 190  # learnt from a few dozen texts
    kept = [r[0] for r in steps["near_dedup"]]
    shingles = {}
    for r in steps["toxicity"]:
        words = (r[1] or "").split()
        shingles[r[0]] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    left = dict(shingles)
    want = []
    for i in sorted(shingles):  # plain search
        if i in left:
            todo = [left.pop(i)]
            want.append(i)
            while todo:
                x = todo.pop()
                near = [k for k, f in left.items() if f == x or 5 * len(f & x) >= 4 * len(f | x) > 0]
                todo += [left.pop(k) for k in near]
    assert sorted(kept) == want and not set(kept) & set(range(240, 251)) & left.keys()
    private = {r[0]: r[1] for r in steps["pii"]}
    assert private[252].endswith(" <email> or <ip> or <card> on")
    assert {i: t for i, t in private.items() if i != 252} == {r[0]: r[1] for r in steps["near_dedup"] if r[0] != 252}
    assert all(r[4] == len(r[1]) for r in steps["pii"] if r[1] is not None)
    mixed = [r[0] for r in steps["mixing"]]
    assert set(mixed) <= set(private) and 0 < len(mixed)
    total = sum(len(re.findall(r"[^ \t\n\r]+", t or "")) for t in private.values())
    assert sum(len((r[1] or "").split()) for r in steps["mixing"]) <= total * 3 // 5


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    assert rows and all(r.length & (r.length - 1) == 0 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    per = {}
    for r in rows:
        per[r.doc_id, r.doc_tokens] = per.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert all(n % tokens == 0 for (_, tokens), n in per.items())


def test_stages_on_empty_and_null_rows_and_extra_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", "1 AS row", "'x' AS spans", "2 AS tokens", "3 AS root", "4 AS place")
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "y", 2, 3, 4)] * 2 + [(900, "", "en", "src1", 0, 1, "y", 2, 3, 4)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        told = stage(spark, docs.unionByName(odd), tables)
        assert name == "packing" or told.columns == docs.columns, name
        assert told.count() > 0 and stage(spark, docs.limit(0), tables).count() == 0, name


def test_stage_names_and_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES)
