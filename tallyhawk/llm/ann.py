"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of ``BITS`` signs of random projections and keeps the
strings of an index shard as one sorted array. A query descends each tree to its longest
matching prefix that holds a few times ``k`` entries, then all trees ascend together, taking
every entry that shares the shorter prefix. How far depends on what is found: two vectors at
an angle share a prefix of a given length in some tree with a known chance, and the ascent
ends where a vector as near as the ``k``-th best so far would be missed with a chance of at
most ``miss``. Where neighbours are close that is deep down and few rows are scored; where
they are hardly nearer than the rest, as among vectors without structure, it is near the
root. Candidates are scored exactly on the original vectors.

Largest inner product becomes smallest angle by one more component: index vectors are
scaled by the longest length in the table and filled up to length one, queries get a zero.

Index shards hold about ``SHARD`` rows dealt by a hash of the id; query blocks hold about
``BLOCK`` queries; each block meets each shard in a task of its own and gives the shard's
best ``k``, from which a window takes the best of all. A shard travels once for every
``BLOCK`` queries and a query once for every ``SHARD`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.llm.common import written
from tallyhawk.llm.vectors import dimension, matrix, unpack, usable

SHARD = 16_384
BLOCK = 16_384
BITS = 32
_AT_ONCE = 1024  # queries whose prefix ranges are held


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    """[dim + 1, trees * BITS] random projections."""
    return np.random.default_rng(seed).normal(size=(dim + 1, trees * BITS))


def hash_strings(x: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """[trees, rows] strings as uint32, first sign in the top bit."""
    signs = (x @ projections > 0).reshape(len(x), -1, BITS)
    packed = np.packbits(signs, axis=2)
    return np.ascontiguousarray(packed.view(">u4")[:, :, 0].T).astype(np.uint32)


def _prefix_ranges(keys: np.ndarray, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """[trees, queries] first and past-the-last position of the entries that share ``length`` leading bits."""
    drop = np.uint64(BITS - length)
    low = (asked.astype(np.uint64) >> drop) << drop
    high = low + (np.uint64(1) << drop)
    lo = np.stack([np.searchsorted(k, a) for k, a in zip(keys, low, strict=True)])
    hi = np.stack([np.searchsorted(k, a) for k, a in zip(keys, high, strict=True)])
    return lo, hi


def deepest_enough(angle: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """The longest prefix at which a vector at ``angle`` from the query shares it in some tree but for a chance of ``miss``; 0: take all."""
    same = np.clip(1 - angle / np.pi, 1e-12, 1 - 1e-12)  # chance that one bit agrees
    return np.clip(np.floor(np.log(1 - miss ** (1 / trees)) / np.log(same)), 0, BITS).astype(np.int64)


class Shard:
    """One index shard: sorted hash strings a tree, the rows they came from, and the vectors."""

    def __init__(self, keys: np.ndarray, order: np.ndarray, x: np.ndarray, longest: float):
        self.keys, self.order, self.x, self.longest = keys.astype(np.uint64), order, x, longest
        self.mask = np.zeros(len(x), bool)
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.ranges:
            self.ranges[length] = _prefix_ranges(self.keys, self.asked, length)
        return self.ranges[length]

    def _taken(self, q: int, length: int) -> np.ndarray:
        if length == 0:
            return np.arange(len(self.x))
        lo, hi = self._at(length)
        for order, s, e in zip(self.order, lo[:, q].tolist(), hi[:, q].tolist(), strict=True):
            self.mask[order[s:e]] = True
        found = np.nonzero(self.mask)[0]
        self.mask[found] = False
        return found

    def search(self, asked: np.ndarray, vectors: np.ndarray, k: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of each query and their scores. ``k`` counts the query itself, which may be among them."""
        self.asked, self.ranges = asked, {}
        level = np.zeros(asked.shape[1], np.int64)
        # Descend: the longest prefix at which the trees together hold a few times k entries.
        for length in range(min(BITS, int(np.log2(len(self.x) + 1)) + 12), 0, -1):
            lo, hi = self._at(length)
            level[(level == 0) & ((hi - lo).sum(axis=0) >= 8 * k)] = length
            if (level > 0).all():
                break
        for q, v in enumerate(vectors):
            at, reach = int(level[q]), self.longest * float(np.linalg.norm(v))
            while True:
                found = self._taken(q, at)
                score = self.x[found] @ v
                if at == 0:
                    break
                if len(found) >= k:
                    # Ascend in all trees to where rows as near as the k-th found are hardly missed.
                    kth = np.partition(score, len(score) - k)[len(score) - k]
                    wanted = int(deepest_enough(np.arccos(np.clip(kth / reach, -1, 1)), len(self.keys), miss))
                    if wanted >= at:
                        break
                    # What is found on the way up is nearer and may end the way sooner.
                    at = max(wanted, at - 3)
                else:
                    at -= 1
            yield found, score


def _pack(dim: int, projections: np.ndarray, longest: float, asked: bool):
    def pack(t: pd.DataFrame) -> pd.DataFrame:
        x = matrix(t["vector"])
        t["bytes"] = [r.tobytes() for r in x]  # of an id's differing rows the same one in every run
        t = t.sort_values(["id", "bytes"]).drop_duplicates("id")
        x = matrix(t["vector"])
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if asked:
            unit = np.hstack([x / length, np.zeros((len(x), 1))])
        else:
            unit = np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))])
        keys = hash_strings(unit, projections)
        order = np.zeros((0, 0), np.int32)
        if not asked:
            order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
            keys = np.take_along_axis(keys, order, axis=1)
        return pd.DataFrame(
            {
                "part": [int(t["part"].iat[0])], "asked": [asked], "ids": [t["id"].to_numpy().tobytes()],
                "vectors": [x.tobytes()], "keys": [keys.tobytes()], "order": [order.tobytes()],
            }
        )

    return pack


_PACKED = "part int, asked boolean, ids binary, vectors binary, keys binary, order binary"


def _answer(dim: int, trees: int, k: int, miss: float, longest: float):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(t) == 2:
            ask, held = t[t["asked"]].iloc[0], t[~t["asked"]].iloc[0]
            ids, x = np.frombuffer(held["ids"], np.int64), unpack(held["vectors"], dim)
            shard = Shard(np.frombuffer(held["keys"], np.uint32).reshape(trees, -1), np.frombuffer(held["order"], np.int32).reshape(trees, -1), x, longest)
            q_ids, q = np.frombuffer(ask["ids"], np.int64), unpack(ask["vectors"], dim)
            q_keys = np.frombuffer(ask["keys"], np.uint32).reshape(trees, -1)
            some = range(0, len(q_ids), _AT_ONCE)
            told = (f for at in some for f in shard.search(q_keys[:, at : at + _AT_ONCE], q[at : at + _AT_ONCE], k + 1, miss))
            for i, (found, score) in enumerate(told):
                other = ids[found] != q_ids[i]
                found, score = found[other], score[other]
                if not len(found):
                    continue
                if len(found) > k:
                    cut = np.partition(score, len(found) - k)[len(found) - k]
                    found = found[score >= cut - 1e-9 * (1 + abs(cut))]  # ties stay until the exact sums are there
                score = (x[found] * q[i]).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), q_ids[i]), ids[found[best]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def nearest(
    df: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding",
    k: int = 20, trees: int = 48, miss: float = 0.1, seed: int = 17,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each query row.

    ``queries`` says which rows ask. Null, zero and non-finite vectors and those of another
    than the usual length take no part; an id's repeated rows count once (differing ones: the least
    by its bytes) and never answer that id; equal scores go by the smaller id. An empty table gives an empty result.
    """
    dim = dimension(df, vector)
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable("vector", dim) & F.col("id").isNotNull())
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.sqrt(F.max(square)).alias("longest")).head()
    shards, blocks = max(1, -(-size["n"] // SHARD)), max(1, -(-size["q"] // BLOCK))
    projections, longest = planes(dim, trees, seed), float(size["longest"] or 1.0)

    def packed(part: DataFrame, n: int, asked: bool) -> DataFrame:
        dealt = part.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"))
        return written(dealt.groupBy("part").applyInPandas(_pack(dim, projections, longest, asked), _PACKED))

    index = packed(rows, shards, False)
    asking = packed(rows.where("asks"), blocks, True)
    pairs = index.select("*", F.col("part").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).unionByName(
        asking.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("part").alias("block"))
    )
    found = pairs.groupBy("shard", "block").applyInPandas(_answer(dim, trees, k, miss, longest), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
