"""Connected components by repeated contraction, as joins and partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import few, released, written


#: Edges up to which one task holds them all (about 4 MB): rounds over small tables then cost a few tasks, not a shuffle each.
_ONE_TASK = 1 << 18


def _order(c: str, turn: int):
    # A hashed order, another in each round, so that neither chains of ascending ids nor a star with an unlucky centre last long.
    return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, root long) for every node of an edge; equal roots mean connected.

    Each round maps every node to its least neighbour (itself included) in a hashed order of
    that round and contracts the edges. A node with a neighbour stays with a chance of at
    most one half, so the expected number of rounds is logarithmic. Only min() with map-side
    partial aggregation and joins that adaptive execution can split touch a hot node. No
    edges give an empty result; loops and repeated edges do not matter.
    """
    left = written(_undirected(edges, a, b))
    roots, turn = None, 0
    while n := left.count():
        rows = left.coalesce(1) if n <= _ONE_TASK else left
        both = rows.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        parent = written(
            both.groupBy("a")
            .agg(F.min(_order("b", turn)).alias("m"))
            .select(
                F.col("a").alias("node"),
                F.when(F.col("m") < _order("a", turn), F.col("m.v")).otherwise(F.col("a")).alias("parent"),
            )
        )
        past = [left, parent]
        if roots is None:
            roots, past = parent.select("node", F.col("parent").alias("root")), [left]
        else:
            step = parent.select(F.col("node").alias("root"), "parent")
            roots = written(
                roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
            )
        turn += 1
        # Edges have two nodes at most each.
        pa = few(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), bound=2 * n)
        pb = few(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), bound=2 * n)
        left = written(_undirected(rows.join(pa, "a").join(pb, "b"), "pa", "pb"))
        for table in past:
            released(table)
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
