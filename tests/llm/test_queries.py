"""The registered queries on the smallest driver tables: result columns, whole tables, and plain versions."""

import hashlib
import os
import zlib

import pytest

from tallyhawk.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")

SHAPES = {
    "op1": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4": "query_id bigint, rank int, vec_id bigint, score double",
    "op5": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9": "doc_id bigint, fingerprint string, component_id bigint",
    "op10": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op13": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}


@pytest.fixture(scope="module")
def results(spark):
    return {n.split("_")[0]: f(spark, SF).cache() for n, f in queries.QUERIES.items()}


def test_shapes_and_whole_tables(spark, results):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for op, shape in SHAPES.items():
        have = dict(results[op].dtypes)
        for column in shape.split(", "):
            name, kind = column.split()
            assert have[name] == kind, (op, name)
    n = docs.count()
    for op in ("op3", "op6", "op8", "op9", "op10", "op12"):
        assert results[op].count() == n
    assert results["op2"].count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_packing_covers_every_token(spark, results):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.VOCABULARY)
    pieces = {}
    for r in results["op1"].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_conversations_come_back(spark, results):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append(r)
    turns[-1] = [type("R", (), dict(turn=0, role="user", text=queries.CONTROL)), type("R", (), dict(turn=1, role="assistant", text=queries.CONTROL))]
    got = {r.conv_id: r for r in results["op5"].collect()}
    assert got.keys() == turns.keys()
    for conv, rows in turns.items():
        rows.sort(key=lambda r: r.turn)
        said = "".join(f"{r.role}\n{r.text or ''}\n" for r in rows)
        learnt = "".join(r.text or "" for r in rows if r.role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_folds(spark, results):
    for r in results["op3"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    for r in results["op10"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


@pytest.mark.parametrize("op", ["op2", "op5", "op7", "op11", "op13"])
def test_queries_equal_sql(spark, results, op):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    told = con.execute(next(q for n, q in queries.ORACLES.items() if n.split("_")[0] == op))
    names = [d[0] for d in told.description]
    have = [tuple(r[n] for n in names) for r in results[op].collect()]
    assert sorted(map(str, have)) == sorted(map(str, told.fetchall()))
