"""Joins of matches and events with static tables: suppression, enrichment, lookups, first sight.

Static sides are given to Spark as they are: it broadcasts what its statistics or its
adaptive plan show to be under the session's limit and shuffles the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(pairs: dict[str, str], right: DataFrame) -> tuple[DataFrame, list[Column], list[str]]:
    names = [f"_key_{k}" for k in range(len(pairs))]
    keyed = right.select("*", *[F.col(r).alias(n) for r, n in zip(pairs.values(), names, strict=True)])
    return keyed, [F.col(left) == F.col(n) for left, n in zip(pairs, names, strict=True)], names


def anti(df: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose key is not in ``table``; a null key is in none."""
    keyed, cond, names = _on(on, table)
    return df.join(keyed.select(*names), cond, "left_anti")


def one_per_key(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, so that enrichment never multiplies rows. Combines before its shuffle."""
    rest = [c for c in table.columns if c not in keys]
    first = table.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def snapshot(df: DataFrame, table: DataFrame, on: dict[str, str], take: dict[str, str], order: list[str], required: bool = False) -> DataFrame:
    """``df`` with columns of its key's row in ``table`` (new name: column), null where there is none.

    ``required`` keeps only rows that have one (the guarded form).
    """
    keyed, cond, names = _on(on, one_per_key(table, list(on.values()), order))
    keyed = keyed.select(*names, *[F.col(c).alias(n) for n, c in take.items()])
    return df.join(keyed, cond, "inner" if required else "left").drop(*names)


def exists(df: DataFrame, table: DataFrame, on: dict[str, str], out: str) -> DataFrame:
    """``df`` with the boolean ``out``: is the key in ``table``? False for a null key."""
    keyed, cond, names = _on(on, table)
    keyed = keyed.select(*names).distinct().withColumn(out, F.lit(True))
    return df.join(keyed, cond, "left").withColumn(out, F.coalesce(out, F.lit(False))).drop(*names)


def has(df: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose key is in ``table``."""
    keyed, cond, names = _on(on, table)
    return df.join(keyed.select(*names), cond, "left_semi")


def first_seen(df: DataFrame, pair: list[str], ts: str, order: str, history: DataFrame | None = None) -> DataFrame:
    """The first row of each combination of ``pair``, if ``history`` (same columns) does not know it."""
    fresh = anti(df, history, {p: p for p in pair}) if history is not None else df
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy(ts, order))
    return fresh.withColumn("_n", rank).where("_n = 1").drop("_n")
