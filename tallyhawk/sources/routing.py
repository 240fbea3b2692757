"""Stream tags: which window a row belongs to, and why some belong to none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = "_tag"
UNKNOWN, MISSING = "unknown_stream_schema", "missing_stream_tag_field"


def tag(df: DataFrame, fixed: str = "", field: str = "stream_tag") -> DataFrame:
    """``df`` with its stream tag: the fixed one for every row if set, else the field's value, blank counting as none."""
    if fixed:
        return df.withColumn(TAG, F.lit(fixed))
    own = F.nullif(F.trim(F.col(field).cast("string")), F.lit("")) if field in df.columns else F.lit(None).cast("string")
    return df.withColumn(TAG, own)


def window(df: DataFrame, tag_name: str, *fields: str | Column) -> DataFrame:
    """The rows of one tag with the window's own fields; one tag may feed any number of windows."""
    rows = df.where(F.col(TAG) == tag_name)
    return rows.select(*fields) if fields else rows


def misses(df: DataFrame, known: list[str], source: str = "_source") -> DataFrame:
    """``source, reason, rows`` for rows that no window takes."""
    reason = F.when(F.col(TAG).isNull(), MISSING).when(~F.col(TAG).isin(*known), UNKNOWN)
    who = F.col(source) if source in df.columns else F.lit("")
    return df.select(who.alias("source"), reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rows"))
