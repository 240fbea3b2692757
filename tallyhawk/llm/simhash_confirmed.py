"""Near-copies by wide SimHash fingerprints, each link confirmed by its shingles.

``simhash`` links by the fingerprint alone; here it only proposes. A text's set of
``SHINGLE``-word shingles gives a fingerprint of 256 bits, and two texts are linked if their
sets share at least ``SHARE`` of their union. At a share of 0.8 two fingerprints differ in 39
bits on average with a deviation of 6, so ``RADIUS`` 54 keeps all but four in a thousand such
pairs; closer ones are kept more surely.

Equal sets are made one first. Rows meet in ``TABLES`` tables keyed by four of a
fingerprint's 64 nibbles; a pair at 0.8 shares no key with a chance of 8 in 1,000, one at 0.9
of 5 in 1,000,000. A bucket (in chunks of about ``CHUNK`` rows, if it is larger) is compared
as bit planes with carry-save counters. A chunk of few pairs gives all of them. A chunk of
many gives each row's pair with its best-linked neighbour, and is opened again once these
are counted out: then only rows of different components meet, the bucket's largest
component not with itself, so a large group of copies costs links in proportion to its rows.
There fingerprints of 2048 bits are compared, in which hardly a pair below 0.7 is within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import few, unused, written
from tallyhawk.llm.components import connected_components
from tallyhawk.llm.simhash import cross_links, fingerprint_of, group_links, shingle_hashes

SHINGLE = 5
SHARE = (4, 5)
WORDS = 4  # of 64 bits
RADIUS = 54
WIDE, WIDE_RADIUS = 32, 366  # in opened buckets; a pair at 0.8 differs in 310 of 2048 bits on average with a deviation of 16
TABLES = 64
CHUNK = 512
_SEED = 42
_DENSE = 2  # pairs a row from which on a chunk gives one pair a row
#: Which four nibbles of a fingerprint key a table: fixed draws without repetition within a table.
_NIBBLES = np.array([np.random.default_rng([6, t]).permutation(16 * WORDS)[:4] for t in range(TABLES)])
_F = [f"f{i}" for i in range(WORDS)]


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def _key(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), _SEED)], np.uint64).view(np.int64)[0])


def buckets(fps: np.ndarray) -> np.ndarray:
    """[n, TABLES] keys of [n, WORDS] fingerprints: the table's number and its four nibbles."""
    nibbles = (fps.reshape(-1, WORDS, 1) >> (np.arange(16, dtype=np.uint64) * np.uint64(4)) & np.uint64(15)).reshape(-1, 16 * WORDS).astype(np.int32)
    out = np.broadcast_to(np.arange(TABLES, dtype=np.int32), (len(fps), TABLES))
    for k in range(_NIBBLES.shape[1]):
        out = out << 4 | nibbles[:, _NIBBLES[:, k]]
    return out


def _prints(text: str) -> Column:
    # The keys are worked out here and not as columns, whose 256 expressions would stand in every plan that reads them.
    @F.pandas_udf("struct<key long, n int, " + ", ".join(f"{f} long" for f in _F) + ", buckets array<int>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        fps = np.array([fingerprint_of(s, WORDS) for s in sets], np.uint64).reshape(-1, WORDS)
        return pd.DataFrame(
            {"key": [_key(s) for s in sets], "n": [len(s) for s in sets], **{f: np.ascontiguousarray(fps[:, i]).view(np.int64) for i, f in enumerate(_F)}, "buckets": list(buckets(fps))}
        )

    return of(text)


def _hashes(text: str) -> Column:
    @F.pandas_udf("struct<hashes array<long>, wide binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"hashes": pd.Series([s.view(np.int64) for s in sets], dtype=object), "wide": [fingerprint_of(s, WIDE).tobytes() for s in sets]})

    return of(text)


def _spread(sets: DataFrame) -> DataFrame:
    """A row for each table that a set stands in."""
    return sets.where("n > 0").select("key", *_F, F.explode("buckets").alias("bucket"))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.int32())])


def _best_linked(i: np.ndarray, j: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row with a better-linked neighbour, that neighbour; rank is by links, then place."""
    rank = np.empty(rows, np.int64)
    rank[np.lexsort((-np.arange(rows), np.bincount(i, minlength=rows) + np.bincount(j, minlength=rows)))] = np.arange(rows)
    best = np.full(rows, -1)
    np.maximum.at(best, i, rank[j])
    np.maximum.at(best, j, rank[i])
    at = np.nonzero(best > rank)[0]
    return at, np.argsort(rank)[best[at]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the radius of each chunk of the sorted rows, and the buckets to be opened again."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        bucket, chunk, chunks, key = (t.column(c).to_numpy() for c in ("bucket", "chunk", "chunks", "key"))
        change = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])))
        group = np.cumsum(change) - 1
        size = np.bincount(group)
        i, j = group_links(np.stack([t.column(f).to_numpy() for f in _F], axis=1).view(np.uint64), group, RADIUS)
        dense = np.bincount(group[i], minlength=len(size)) > _DENSE * size
        many = dense[group[i]]
        p, q = _best_linked(i[many], j[many], len(t))
        i, j = np.concatenate((i[~many], p)), np.concatenate((j[~many], q))
        first = np.nonzero(change)[0]
        again = np.unique(bucket[first[dense | (chunks[first] > 1)]])
        none = np.zeros(len(again), np.int64)
        is_open = np.arange(len(i) + len(again)) >= len(i)
        a, b = (np.concatenate((side(key[i], key[j]), none)) for side in (np.minimum, np.maximum))
        open_ = np.concatenate((np.zeros(len(i), np.int32), again.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(a, mask=is_open), pa.array(b, mask=is_open), pa.array(open_, mask=~is_open)], schema=_PAIRS)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < 1 << 14:
            continue
        t = pa.Table.from_batches(held)
        bucket, chunk = t.column("bucket").to_numpy(), t.column("chunk").to_numpy()
        whole = int(((bucket != bucket[-1]) | (chunk != chunk[-1])).sum())
        if whole:
            yield emit(t.slice(0, whole))
        held, n = t.slice(whole).to_batches(), len(t) - whole
    if n:
        yield emit(pa.Table.from_batches(held))


def _candidates(sets: DataFrame) -> DataFrame:
    """``a, b`` (keys, a < b) of pairs proposed, or ``open``: a bucket of more pairs than were given."""
    rows = _spread(sets)
    large = few(written(rows.groupBy("bucket").count().where(F.col("count") > CHUNK).select("bucket", F.ceil(F.col("count") / (CHUNK * 0.8)).cast("int").alias("chunks"))))
    # The salt differs from table to table, so that chunks of one group overlap those of another table.
    chunk = F.coalesce(F.pmod(F.xxhash64("key", "bucket"), F.col("chunks")).cast("int"), F.lit(0))
    chunked = rows.join(large, "bucket", "left").select("key", *_F, "bucket", chunk.alias("chunk"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
    return chunked.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(_compare, "a long, b long, open int")


def _pack(t: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "bucket": [t["bucket"].iat[0]], "rest": [t["rest"].iat[0]], "chunk": [t["chunk"].iat[0]], "mains": [t["mains"].iat[0]], "rests": [t["rests"].iat[0]],
            "keys": [t["key"].to_numpy(np.int64).tobytes()], "roots": [t["root"].to_numpy(np.int64).tobytes()], "fps": [b"".join(t["wide"])],
        }
    )


def _tile(t: pd.DataFrame) -> pd.DataFrame:
    x = t.iloc[0]
    y = t.iloc[-1]
    (ka, ra), (kb, rb) = [[np.frombuffer(s[c], np.int64) for c in ("keys", "roots")] for s in (x, y)]
    fa, fb = [np.frombuffer(s["fps"], np.uint64).reshape(-1, WIDE) for s in (x, y)]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in cross_links(fa, fb, WIDE_RADIUS):
        new = ra[i] != rb[j]
        out.append((ka[i[new]], kb[j[new]]))
    a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _across(rows: DataFrame, roots: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs within the radius of the opened buckets' ``rows`` (bucket, key) whose components differ, a bucket's largest component not among itself."""
    rows = written(rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root")))
    sizes = rows.groupBy("bucket", "root").count()
    main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("of_main"), F.sum("count").alias("of_all")).where("of_all > of_main")
    chunks = lambda n: F.ceil(n / (CHUNK * 0.8)).cast("int")
    main = main.select("bucket", "main", chunks(F.col("of_main")).alias("mains"), chunks(F.col("of_all") - F.col("of_main")).alias("rests"))
    rest = F.col("root") != F.col("main")
    dealt = rows.join(few(written(main)), "bucket").select(
        "bucket", rest.alias("rest"), F.pmod(F.xxhash64("key"), F.when(rest, F.col("rests")).otherwise(F.col("mains"))).cast("int").alias("chunk"), "mains", "rests", "key", "root"
    ).join(sides.select("key", "wide"), "key")
    shape = "bucket int, rest boolean, chunk int, mains int, rests int, keys binary, roots binary, fps binary"
    packed = written(dealt.groupBy("bucket", "rest", "chunk").applyInPandas(_pack, shape))
    # A tile is chunk i of the rest against chunk j of the main component, or of the rest from i on.
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    body = ["bucket", "keys", "roots", "fps"]
    others = packed.where("rest")
    with_main = others.select(*body, F.col("chunk").alias("i"), F.lit(False).alias("kind"), F.explode(upto(F.col("mains"))).alias("j"))
    of_main = packed.where("NOT rest").select(*body, F.explode(upto(F.col("rests"))).alias("i"), F.lit(False).alias("kind"), F.col("chunk").alias("j"))
    with_rest = others.select(*body, F.col("chunk").alias("i"), F.lit(True).alias("kind"), F.explode(F.sequence(F.col("chunk"), F.col("rests") - 1)).alias("j"))
    of_rest = others.where("chunk > 0").select(*body, F.explode(upto(F.col("chunk"))).alias("i"), F.lit(True).alias("kind"), F.col("chunk").alias("j"))
    tiles = with_main.union(of_main).union(with_rest).union(of_rest)
    return tiles.groupBy("bucket", "i", "kind", "j").applyInPandas(_tile, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sets share enough."""
    with_a = pairs.join(sides.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a")
    both = with_a.join(sides.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b")
    less, more = F.least(F.size("ha"), F.size("hb")), F.greatest(F.size("ha"), F.size("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))  # s / (a + b - s) >= p / q is s (p + q) >= (a + b) p
    return both.where((less * SHARE[1] >= more * SHARE[0]) & (shared * sum(SHARE) >= (less + more) * SHARE[0])).select("a", "b")


def _linked(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the sets that have a link."""
    found = written(_candidates(sets))
    pairs = written(found.where("open IS NULL").select("a", "b").distinct())
    opened = written(found.where("open IS NOT NULL").select(F.col("open").alias("bucket")).distinct())
    in_open = written(_spread(sets).join(few(opened), "bucket").select("bucket", "key"))
    in_pairs = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    asked = written(in_pairs.union(in_open.select("key")).distinct().join(sets, "key").select("key", "th"))
    sides = written(texts.join(few(asked), "th").dropDuplicates(["key"]).select("key", _hashes("text").alias("h")).select("key", "h.*"))
    edges = written(_confirmed(pairs, sides))
    roots = connected_components(edges)
    if opened.isEmpty():
        return roots
    fresh = written(_across(in_open, roots, sides).join(pairs, ["a", "b"], "left_anti"))
    # What is linked already meets as its root, so the edges are not gone through again.
    named = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    late = written(_confirmed(fresh, sides)).join(named[0], "a", "left").join(named[1], "b", "left")
    late = written(late.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    merged = connected_components(late)
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.union(merged.join(roots.select("node"), "node", "left_anti"))


def _grouped(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """``doc_id, th, root`` and ``more`` of every row; equal roots are linked."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).cast("binary").alias("text"), *more)
    extra = [c for c in raw.columns if c != "text"]
    prints = written(raw.select(*extra, _prints("text").alias("p")).select(*extra, "p.*"))
    one = F.first(F.struct("n", *_F, "buckets"))
    sets = written(prints.groupBy("key").agg(F.min("th").alias("th"), one.alias("p")).select("key", "th", "p.*"))
    roots = _linked(sets, raw.select("th", "text"))
    return prints.select(*extra, "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select(*extra, F.coalesce("root", "key").alias("root"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, component_id``, the least id reachable by links.

    Null, empty and wordless texts are equal to each other and like no other.
    """
    rows = written(_grouped(docs, doc_id, text))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the least id, of its rows the least by a hash of text and columns.

    Different texts under one id are told apart: each stays unless it is linked to another
    row. Rows without an id cannot be named as a copy of another and stay.
    """
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    mark = unused(docs, "row_hash")
    marked = docs.withColumn(mark, F.xxhash64(*plain))
    rows = written(_grouped(marked.where(F.col(doc_id).isNotNull()), doc_id, text, F.col(mark).alias("row")))
    best = rows.groupBy("root").agg(F.min(F.struct("doc_id", "th", "row")).alias("best")).select("best.doc_id", "best.row", F.lit(True).alias("stays"))
    seen = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("copies")).join(best, ["doc_id", "row"], "left")
    seen = written(seen.where("stays IS NULL OR copies > 1"))
    on = lambda names: [F.col(c).eqNullSafe(F.col(n)) for c, n in zip((doc_id, mark), names, strict=True)]
    at = [unused(docs, "at_id"), unused(docs, "at_row")]
    leaves = few(seen.select("doc_id", "row").toDF(*at))
    once = marked.join(leaves, on(at), "left_anti").select(docs.columns)
    # Only rows that stand there several times, alike in all columns, go through a shuffle to become one.
    again = few(seen.where("stays").select("doc_id", "row").toDF(*at))
    several = marked.join(again, on(at), "left_semi").dropDuplicates([doc_id, mark]).select(docs.columns)
    return once.unionByName(several)
