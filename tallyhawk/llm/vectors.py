"""What both vector operators need: which vectors take part, and blocks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str, dim: int) -> Column:
    """Of ``dim`` components, all finite, not all zero. False, never null, otherwise."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(x) == dim) & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent vector length (ties: the larger); 0 if there is none."""
    top = df.select(F.size(vector).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).head()
    return top["n"] if top else 0


def matrix(column) -> np.ndarray:
    """A column of equally long lists or arrays as float64 rows."""
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def unpack(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dim)
