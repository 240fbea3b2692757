"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are grouped first, so copies cost one aggregation and no pair. The distinct
vectors are scaled to length one and turned to the principal axes of the whole table, which
puts most of a product into the leading dimensions. Blocks of at most about ``BLOCK``
vectors, and at least ``FEWEST`` of them, are cut along the first axis; unit vectors with
cosine t differ there by at most sqrt(2 - 2t), so blocks further apart than that never meet,
nor do tiles. A vector travels once for every block that its own meets, so up to ``FEWEST``
blocks the rows moved grow as the table, and then with the square at 1 / ``BLOCK`` of it,
which is inherent in all pairs. A pair of blocks goes tile by tile: the
product over the leading dimensions plus the product of the two suffix norms bounds the
cosine (Cauchy-Schwarz), comparison stops where the bound stays below the threshold, and
what is left takes more dimensions, at last all of them in double precision. A tile gives
a link count for each vector and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import written
from tallyhawk.llm.components import connected_components
from tallyhawk.llm.forest import merge
from tallyhawk.llm.vectors import dimension, matrix, unpack, usable

BLOCK = 1 << 16
FEWEST = 5
_TILE = 1024
_SLACK = 1e-5  # single-precision bounds stay above the true cosine by this


def _moments(dim: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for t in frames:
            if len(t):
                x = matrix(t["vector"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        yield pd.DataFrame({"lot": [TaskContext.get().partitionId() % 32], "moments": [total.tobytes()]})

    return run


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """[dim, dim] axes by falling second moment of the unit vectors; 32 small sums reach the driver."""

    def add(t: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, np.float64) for m in t["moments"])
        return pd.DataFrame({"moments": [total.tobytes()]})

    parts = vectors.select("vector").mapInPandas(_moments(dim), "lot int, moments binary")
    sums = [np.frombuffer(r.moments, np.float64) for r in parts.groupBy("lot").applyInPandas(add, "moments binary").collect()]
    total = sum(sums).reshape(dim, dim) if sums else np.eye(dim)
    values, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, ::-1])


def _steps(dim: int) -> list[int]:
    cuts = [c for c in (16, 32) if c < dim]
    return [*cuts, dim]


def _tile_pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with x[i] . y[j] >= least, for rows of length one in principal axes."""
    dim = x.shape[1]
    steps = _steps(dim)
    rows, cols = np.arange(len(x)), np.arange(len(y))
    for upto in steps[:-1]:
        # One product of leading dimensions and suffix norms is the bound itself.
        a, b = x[rows], y[cols]
        a = np.hstack([a[:, :upto], np.linalg.norm(a[:, upto:], axis=1, keepdims=True)]).astype(np.float32)
        b = np.hstack([b[:, :upto], np.linalg.norm(b[:, upto:], axis=1, keepdims=True)]).astype(np.float32)
        open_ = a @ b.T >= least - _SLACK
        if not open_.any():
            return rows[:0], cols[:0]
        i, j = np.nonzero(open_)
        if len(i) <= 0.02 * open_.size:
            i, j = rows[i], cols[j]
            break
        rows, cols = rows[open_.any(axis=1)], cols[open_.any(axis=0)]
    else:
        i, j = np.nonzero(x[rows] @ y[cols].T >= least)
        return rows[i], cols[j]
    hit = [np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)]
    hit = np.concatenate(hit)
    return i[hit], j[hit]


def _compare(dim: int, least: float, reach: float):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("block")
        ids = [np.frombuffer(b, np.int64) for b in t["ids"]]
        copies = [np.frombuffer(b, np.int64) for b in t["copies"]]
        xs = [unpack(b, dim) for b in t["vectors"]]
        same = len(t) == 1
        x, y = xs[0], xs[-1]
        base = 0 if same else len(x)
        all_ids = ids[0] if same else np.concatenate(ids)
        count = np.zeros(len(all_ids), np.int64)
        label = np.arange(len(all_ids))
        for at in range(0, len(x), _TILE):
            for to in range(at if same else 0, len(y), _TILE):
                if y[to, 0] - x[at : at + _TILE][-1, 0] > reach:  # rows are in the first axis' order
                    break
                i, j = _tile_pairs(x[at : at + _TILE], y[to : to + _TILE], least)
                i, j = i + at, j + to
                if same:
                    once = i < j
                    i, j = i[once], j[once]
                if not len(i):
                    continue
                count += np.bincount(i, weights=copies[-1][j], minlength=len(count)).astype(np.int64)
                count += np.bincount(j + base, weights=copies[0][i], minlength=len(count)).astype(np.int64)
                label = merge(label, i, j + base)
        linked = np.nonzero(count)[0]
        return pd.DataFrame({"id": all_ids[linked], "links": count[linked], "root": all_ids[label[linked]]})

    return run


def _blocks(dim: int, axes: np.ndarray, cuts: np.ndarray, reach: float):
    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            if not len(t):
                continue
            x = matrix(t["vector"])
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
            block = np.searchsorted(cuts, x[:, 0], side="right")
            yield pd.DataFrame({"id": t["id"], "copies": t["copies"], "block": block.astype(np.int32), "turned": [r.tobytes() for r in x]})

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("id")
        x = np.frombuffer(b"".join(t["turned"]), np.float64).reshape(-1, dim)
        order = np.argsort(x[:, 0], kind="stable")
        block = int(t["block"].iat[0])
        last = int(np.searchsorted(cuts, x[:, 0].max() + reach, side="right"))
        ids, copies = t["id"].to_numpy()[order], t["copies"].to_numpy()[order]
        return pd.DataFrame({"block": [block], "last": [last], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "vectors": [x[order].tobytes()]})

    return turn, pack


def _cuts(vectors: DataFrame, axis: np.ndarray, blocks: int) -> np.ndarray:
    """Inner bounds of ``blocks`` equally filled ranges of the first coordinate."""
    if blocks < 2:
        return np.zeros(0)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    along = F.aggregate(F.zip_with("vector", F.lit(axis.tolist()), lambda v, a: v.cast("double") * a), F.lit(0.0), lambda s, v: s + v)
    shares = [i / blocks for i in range(1, blocks)]
    found = vectors.select((along / length).alias("c")).agg(F.percentile_approx("c", shares, max(10_000, 50 * blocks)).alias("q")).head()["q"]
    return np.unique(np.asarray(found or [], dtype=np.float64))


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link at a cosine of ``threshold`` or more. Vectors that are null, zero, of
    another than the table's usual length, or that hold null or non-finite components link
    with nothing. Rows repeated with their id count as vectors of their own; their
    ``component_id`` is the shared id. An empty table gives an empty result.
    """
    dim = dimension(df, vector)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable("vector", dim), F.col("vector")))
    alone = rows.where(F.col("vector").isNull())
    # The class of equal vectors is known by its least id; min and count combine before the shuffle.
    classes = written(
        rows.where(F.col("vector").isNotNull())
        .groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    n = classes.count()
    if n:
        axes = principal_axes(classes, dim)
        reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
        cuts = _cuts(classes, axes[:, 0], max(min(FEWEST, -(-n // _TILE)), -(-n // BLOCK)))
        turn, pack = _blocks(dim, axes, cuts, reach)
        packed = (
            classes.select("id", "copies", "vector").mapInPandas(turn, "id long, copies long, block int, turned binary")
            .groupBy("block").applyInPandas(pack, "block int, last int, ids binary, copies binary, vectors binary")
        )
        packed = written(packed)
        ends = packed.select(F.col("block").alias("i"), "last")
        # Each pair of blocks (i, j) with i <= j <= last(i): block i gets one row for each, block j is told by a join on j.
        pairs = ends.withColumn("j", F.explode(F.sequence("i", "last"))).select("i", "j")
        left = pairs.withColumn("block", F.col("i")).join(packed, "block")
        right = pairs.where("i < j").withColumn("block", F.col("j")).join(packed, "block")
        tiles = left.unionByName(right).select("i", "j", "block", "ids", "copies", "vectors")
        found = written(tiles.groupBy("i", "j").applyInPandas(_compare(dim, threshold, reach), "id long, links long, root long"))
        counts = found.groupBy("id").agg(F.sum("links").alias("links"))
        roots = connected_components(found, "id", "root").withColumnRenamed("node", "id")
        classes = (
            classes.join(counts, "id", "left").join(roots, "id", "left")
            .select("id", "vector", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
        )
        classes = written(classes)
        component = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        named = classes.join(component, "root").select("vector", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
        linked = rows.where(F.col("vector").isNotNull()).join(named, "vector").select("vec_id", "n_links", "component_id")
    else:
        linked = classes.select(F.col("least").alias("vec_id"), F.col("copies").alias("n_links"), F.col("least").alias("component_id"))
    single = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
