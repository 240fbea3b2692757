"""Alert rows: a fixed envelope, the rule's own fields, presets, and what to leave out on delivery."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = ("rule_name", "score", "entity_type", "entity_id", "origin", "close_reason", "fired_at", "emit_time", "summary")
PREFIX = "__tally_"


def envelope(
    df: DataFrame, rule: str, entity: tuple[str, Column], score: Column | float, fired_at: Column, origin: Column | str = "event",
    summary: Column | None = None, emit_time: Column | None = None, **fields: Column,
) -> DataFrame:
    """Alerts of ``rule``: the envelope, then ``fields``. Origin ``close:<reason>`` also sets ``close_reason``."""
    o = F.lit(origin) if isinstance(origin, str) else origin
    s = score if isinstance(score, Column) else F.lit(score)
    return df.select(
        F.lit(rule).alias("rule_name"), s.cast("double").alias("score"), F.lit(entity[0]).alias("entity_type"), entity[1].cast("string").alias("entity_id"),
        o.alias("origin"), F.when(o.startswith("close:"), F.substring(o, 7, 100)).alias("close_reason"), fired_at.alias("fired_at"),
        (emit_time if emit_time is not None else F.current_timestamp()).alias("emit_time"), (summary if summary is not None else F.lit(None).cast("string")).alias("summary"),
        *[c.alias(k) for k, c in fields.items()],
    )


def preset(*presets: dict[str, Column], **explicit: Column) -> dict[str, Column]:
    """Field sets merged from left to right; fields given by name win."""
    out: dict[str, Column] = {}
    for p in presets:
        out |= p
    return out | explicit


def yields(df: DataFrame, shape: T.StructType, fields: dict[str, Column]) -> DataFrame:
    """``fields`` cast to the target's types, in its order; those not given are null, others are refused."""
    extra = set(fields) - set(shape.names)
    if extra:
        raise ValueError(f"not in the target: {sorted(extra)}")
    return df.select(*[(fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def with_prefix(df: DataFrame) -> DataFrame:
    """Envelope columns under the meta prefix, as sinks see them."""
    return df.withColumnsRenamed({c: PREFIX + c for c in META if c in df.columns})


def deliver(df: DataFrame, fields: list[str] | None = None, drop_meta: list[str] | None = None) -> DataFrame:
    """The chosen output fields, then without the meta columns that a name or wildcard of ``drop_meta`` matches.

    Patterns must lie under the meta prefix, so no rule field can be dropped by mistake.
    """
    wrong = [p for p in drop_meta or [] if not p.startswith(PREFIX)]
    if wrong:
        raise ValueError(f"only {PREFIX}* columns can be left out: {wrong}")
    chosen = df.select(*fields) if fields else df
    return chosen.drop(*[c for c in chosen.columns if any(fnmatch(c, p) for p in drop_meta or [])])


def top(alerts: DataFrame, per: list[str], measure: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` alerts of largest ``measure`` among those closing together (equal ``per``); ties by the columns given."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*per).orderBy(measure.desc(), *ties))
    return alerts.withColumn("rank", rank).where(F.col("rank") <= n)


def distinct(alerts: DataFrame) -> DataFrame:
    """One of the alerts that agree in rule, score, entity, origin and firing time."""
    return alerts.dropDuplicates(["rule_name", "score", "entity_type", "entity_id", "origin", "fired_at"])
