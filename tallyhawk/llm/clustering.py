"""Centroid clustering in whole numbers, with the equal-average equal-variance search.

Components are scaled and floored to integers, so every sum, mean and distance is exact and
no order of rows or tasks changes a result. Each round assigns the vectors to their nearest
centroid and replaces every centroid by the floored mean of its vectors.

With S the component sum of a vector and V its deviation (the length of the vector less its
mean in every component), the squared distance of x and c is at least
``(Sx - Sc)^2 / dim + (Vx - Vc)^2``. Centroids are sorted by mean. A vector begins at the
mean nearest to its own and goes outward, to whichever side is nearer in mean; the first
term alone ends the search, since all means further out are further off, and both terms
together skip one centroid. What is left is compared in integers.

Vectors are written once as packed integers with their S and V. A round is one read of that
table: each task adds up its vectors by centroid, Spark adds up the tasks' sums, and the
driver gets one row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import released, written

#: Components up to this size keep squared distances of 64 of them within a long.
LARGEST = 1 << 27
#: Bounds are computed in floating point; they reject only beyond this relative slack.
_SLACK = 1e-9
_BLOCK = 8192


def _kept(vector: Column, dim: int, scale: int) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST))
    return F.coalesce((F.size(vector) == dim) & sound, F.lit(False))


def _packed(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BLOCK):
                part = batch.slice(at, _BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = np.floor(x * scale).astype(np.int64)
                total = x.sum(axis=1)
                spread = np.sqrt(((x - (total / dim)[:, None]) ** 2).sum(axis=1))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.astype("<i4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), packed.cast(pa.binary()), pa.array(total), pa.array(spread)], ["vec_id", "x", "total", "spread"])

    return run


class Search:
    """Nearest of a few centroids, for blocks of vectors."""

    def __init__(self, centroids: np.ndarray):
        self.dim = centroids.shape[1]
        total = centroids.sum(axis=1)
        order = np.argsort(total, kind="stable")
        self.number, self.rows, self.total = order, centroids[order], total[order].astype(np.float64)
        self.spread = np.sqrt(((self.rows - (self.total / self.dim)[:, None]) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray, total: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (ties: the smaller), squared distance, and how many distances were counted out."""
        k, n = len(self.rows), len(x)
        best, found, counted = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), 0
        up = np.searchsorted(self.total, total)
        down = up - 1
        left = np.arange(n)
        while len(left):
            s, lo, hi = total[left], down[left], up[left]
            far_lo = np.where(lo >= 0, s - self.total[np.maximum(lo, 0)], np.inf)
            far_hi = np.where(hi < k, self.total[np.minimum(hi, k - 1)] - s, np.inf)
            at = np.where(far_lo < far_hi, lo, hi)
            mean = np.minimum(far_lo, far_hi) ** 2 / self.dim * (1 - _SLACK)
            go = mean <= best[left]  # false, too, where no centroid is left on either side
            left, at, mean = left[go], at[go], mean[go]
            below = at == down[left]
            down[left[below]] -= 1
            up[left[~below]] += 1
            near = mean + (spread[left] - self.spread[at]) ** 2 * (1 - _SLACK) - _SLACK <= best[left]
            row, at = left[near], at[near]
            counted += len(row)
            d = ((x[row] - self.rows[at]) ** 2).sum(axis=1)
            number = self.number[at]
            better = (d < best[row]) | ((d == best[row]) & (number < found[row]))
            best[row[better]], found[row[better]] = d[better], number[better]
        return found, best, counted


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, len(batch), _BLOCK):
        part = batch.slice(at, _BLOCK)
        x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i4").astype(np.int64).reshape(-1, dim)
        yield part, x, part.column("total").to_numpy(), part.column("spread").to_numpy()


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, (k, dim) = Search(centroids), centroids.shape
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, total, spread in _blocks(batch, dim):
                at, _, _ = search.nearest(x, total, spread)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=k)
        met = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for part, x, total, spread in _blocks(batch, centroids.shape[1]):
                at, d, _ = search.nearest(x, total, spread)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def _first(vectors: DataFrame, count: int, seed: int, dim: int) -> np.ndarray:
    """The start: vectors of the smallest SHA-256 of ``seed:vec_id``."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(told.alias("told"), "x").orderBy("told", "x").limit(count).collect()
    return np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<i4").astype(np.int64).reshape(-1, dim)


def clustered(
    df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors of ``dim`` components take part; those that are null or hold null or non-finite
    components do not, nor do those with a component beyond ``LARGEST / scale``, whose
    distances a long may not hold. Repeated rows count as often as they stand; rows of one
    id start in the order of their packed components; a null id is hashed as empty. With
    fewer than ``k`` vectors each starts a centroid; a centroid that loses all vectors
    stays. An equal distance goes to the smaller number. No vectors give no rows.
    """
    vectors = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    vectors = written(vectors.where(_kept(F.col("x"), dim, scale)).mapInArrow(_packed(dim, scale), "vec_id long, x binary, total long, spread double"))
    centroids = _first(vectors, k, seed, dim)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    added = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]
    for _ in range(rounds):
        sums = vectors.select("x", "total", "spread").mapInArrow(_sums(centroids), "cluster long, n long, s array<long>")
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():  # one row a centroid
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    found = written(vectors.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    released(vectors)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    whole = sum(inertia.values())
    told = [(c, d, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    ends = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
