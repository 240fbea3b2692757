"""Where alerts go: routes by target, formats, and counts of what went where."""

from __future__ import annotations

from dataclasses import dataclass, field
from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhawk.operators.alerts import deliver


@dataclass(frozen=True)
class Sink:
    """A group of targets (names or wildcards) and how to write them: json, kv, text, parquet, jdbc, kafka, blackhole or count."""

    name: str
    targets: tuple[str, ...]
    format: str = "json"
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)
    fields: tuple[str, ...] = ()
    drop_meta: tuple[str, ...] = ()


def route_of(target: Column, sinks: list[Sink]) -> Column:
    """Names of the sinks that take a target, as an array; empty where only the default route does."""
    def takes(s: Sink) -> Column:
        patterns = ["^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in p) + "$" for p in s.targets]
        return reduce(lambda a, b: a | b, [target.rlike(p) for p in patterns])

    return F.filter(F.array(*[F.when(takes(s), s.name) for s in sinks]), lambda x: x.isNotNull())


def routed(alerts: DataFrame, target: str, sinks: list[Sink], default: str = "default") -> DataFrame:
    """``alerts`` once per sink that takes them, with ``_sink``; those that none takes go to ``default``."""
    names = route_of(F.col(target), sinks)
    return alerts.withColumn("_sink", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))))


def split_errors(df: DataFrame, shape: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows in the target's types, rows with a value that cannot be cast), the latter as they came with ``_error`` naming the fields."""
    bad = F.filter(
        F.array(*[F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f.name) for f in shape.fields]), lambda x: x.isNotNull()
    )
    marked = df.withColumn("_error", F.array_join(bad, ","))
    good = marked.where("_error = ''").select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in shape.fields])
    return good, marked.where("_error <> ''")


def key_values(df: DataFrame) -> DataFrame:
    """One text column of ``name=value`` pairs parted by blanks; nulls are left out."""
    return df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns]).alias("value"))


def kafka_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write(df: DataFrame, sink: Sink, mode: str = "append") -> int | None:
    """Write a batch to one sink; gives the number of rows for a count sink."""
    out = deliver(df, list(sink.fields) or None, list(sink.drop_meta))
    if sink.format == "count":
        return out.count()
    writers = {
        "json": lambda: out.write.mode(mode).json(sink.path),
        "parquet": lambda: out.write.mode(mode).parquet(sink.path),
        "kv": lambda: key_values(out).write.mode(mode).text(sink.path),
        "text": lambda: out.select(F.col(out.columns[0]).cast("string")).write.mode(mode).text(sink.path),
        "jdbc": lambda: out.write.mode(mode).format("jdbc").options(**sink.options).save(),
        "kafka": lambda: kafka_records(out).write.format("kafka").options(**sink.options).save(),
        "blackhole": lambda: out.write.mode("overwrite").format("noop").save(),
    }
    writers[sink.format]()
    return None


def write_all(alerts: DataFrame, target: str, sinks: list[Sink], default: Sink) -> dict[str, int | None]:
    """Write every alert to the sinks that take its target. Call it from ``foreachBatch`` in streams."""
    held = routed(alerts, target, sinks, default.name).cache()
    try:
        return {s.name: write(held.where(F.col("_sink") == s.name).drop("_sink"), s) for s in [*sinks, default]}
    finally:
        held.unpersist()


def metrics(df: DataFrame, stage: str, name: str, label: str | Column) -> DataFrame:
    """``stage, name, label, value`` rows counting ``df`` by label."""
    by = F.col(label) if isinstance(label, str) else label
    return df.groupBy(by.cast("string").alias("label")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), "label", "value")


def matching(columns: list[str], patterns: list[str]) -> list[str]:
    return [c for c in columns if any(fnmatch(c, p) for p in patterns)]
