import hashlib
import random
import re
import time

from pii_fixture import planted
from pyspark.sql import functions as F

from tallyhawk.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    v = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(v)) % 10 == 0


def slow(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "nothing", "é a.b@c.d%x@y.zz, 1.2.3.4.5 256.1.1.1 000001.02.3.255", "x@y a@b..c @a.b a@-.-", "😀 +1 (988) 555-2485 4012888888881881 4012-8888 8888-1881-",
    "+1 4012888888881881 1.2.3.4 " * 30, "9" * 3000, "a" * 5000 + "@b" + ".c" * 4000, ("1 " * 6000), "+" + "1" * 40, "4111 1111 1111 1111\n4111111111111112",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string")


def test_base_spans_against_plain_rules(spark):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("0123456789 .-+@ab()%é") for _ in range(rnd.randrange(120))) for _ in range(150)]
    got = {r.doc_id: r for r in pii.digest(rows(spark, texts), support=10_000).collect()}
    for i, t in enumerate(texts):
        want = slow(t)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[i].spans == line and got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in want) for k in pii.KINDS]


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"w{i}x please call my phone +1 (200) 555-{1000 + i} now" for i in range(12)]
    texts += ["and then call my phone 555-7788 now", "he paid 555-7799 there", "call my phone later 77 now"]
    got = [r.spans for r in pii.digest(rows(spark, texts)).orderBy("doc_id").collect()]
    assert got[12] == "phone:23:31" and got[13] == got[14] == ""
    text = [r.text for r in pii.redacted(rows(spark, texts)).orderBy("doc_id").collect()]
    assert text[12] == "and then call my phone <phone> now" and text[0] == "w0x please call my phone <phone> now" and text[13] == texts[13]


def test_redaction_of_overlaps_and_nulls(spark):
    texts = [None, "", "a +1.2.3.4 (555) 12 b", "x é@a.bc a@b.cd"]
    out = pii.redacted(rows(spark, texts))
    assert out.columns == ["doc_id", "text", "row"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == [None, "", "a <phone> b", "x é@a.bc <email>"]
    assert pii.digest(rows(spark, texts).limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    shape = "doc_id long, text string, spans string, base_spans int, email_row int, row int, found string, body string, doc string"
    rows = [(1, "write to a@b.cd now", "s", 1, 2, 3, "f", "b", "d"), (1, "write to a@b.cd now", "s", 1, 2, 3, "f", "b", "d"), (2, None, None, None, None, None, None, None, None), (None, "", "", 0, 0, 0, "", "", "")]
    docs = spark.createDataFrame(rows, shape)
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((a, t and t.replace("a@b.cd", "<email>"), *rest)) for a, t, *rest in rows)
    assert pii.redacted(docs.limit(0)).count() == 0 and pii.digest(docs).count() == 4


def test_planted_identifiers_and_decoys(spark):
    """Seeds, formats that no pattern of the base knows, and numbers in other contexts: what is discovered, and how much of it is right."""
    docs, hidden, decoys = planted(random.Random(5))
    found = set()
    for r in pii.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found |= {(r.doc_id, k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
    assert len(found & hidden) >= 0.9 * len(hidden)
    wrong = {x for x in found if (x[0], x[2], x[3]) in decoys}
    assert not wrong


def test_runs_are_cut_at_base_spans(spark):
    texts = [f"er{i} host 10.0.0.{i} 5559{i:03d}" for i in range(12)] + ["la mail=bob@x.org 10.0.0.9", "er 1234 5678 and 12", "tel=+1 200 555 1000 la"]
    df = rows(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    got = {r.doc_id: [(c.core, c.kind, c.start, c.end) for c in r.c] for r in df.select("doc_id", pii._candidates(F.col("t")).alias("c")).collect()}
    assert got[3][1:] == [("10.0.0.3", "ip", 9, 17), ("5559003", None, 18, 25)]
    assert got[12] == [("bob@x.org", "email", 8, 17), ("10.0.0.9", "ip", 18, 26)]
    assert got[13] == [("1234 5678", None, 3, 12), ("12", None, 17, 19)] and got[14] == [("+1 200 555 1000", "phone", 4, 19)]


def test_long_texts_take_linear_time(spark):
    """Many base spans, many candidates and one long run in a text."""
    texts = ["10.0.0.1 a1 " * 20_000, "12 " * 60_000, "tel=" * 40_000 + "1", "x" * 200_000 + "@", "bob@x.org " * 20_000]
    began = time.perf_counter()
    got = {r.doc_id: r.n for r in pii.located(rows(spark, texts)).select(F.col("doc.doc_id").alias("doc_id"), F.size("base_spans").alias("n")).collect()}
    assert [got[i] for i in range(5)] == [20_000, 0, 0, 0, 20_000]
    assert time.perf_counter() - began < 90


def test_texts_without_open_candidates_are_not_shuffled(spark):
    """Long texts whose identifiers are all of a fixed format, or that have none, beside ones that wait for a discovery."""
    rng = random.Random(4)
    docs, hidden, _ = planted(rng)
    long = [(10_000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=20_000)) + (" tel=+1 234 567 8901" if i % 2 else "")) for i in range(100)]
    sc = spark.sparkContext
    store, before = sc._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup("open", "open")
    try:
        rows = {r.doc.doc_id: r for r in pii.located(spark.createDataFrame(docs + long, "doc_id long, text string")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("open") for s in sc.statusTracker().getJobInfo(j).stageIds}
    ran = [store.lastStageAttempt(s) for s in stages]
    moved = sum(s.shuffleWriteBytes() for s in ran if s.status().toString() == "COMPLETE")
    assert len(rows) == len(docs) + len(long)
    assert all([tuple(s) for s in rows[i].base_spans] == [tuple(s) for s in rows[i].spans] == slow(text) for i, text in long)
    found = {(i, s.kind, s.start, s.end) for i, r in rows.items() for s in r.spans}
    assert hidden and hidden <= found
    assert 0 < moved < sum(len(text) for _, text in long) / 4
