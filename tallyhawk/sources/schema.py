"""Declared event shapes: conforming raw rows to them and finding their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the field types of event schemas and the Spark types that hold them.
TYPES = {
    "chars": "string", "ip": "string", "hex": "string", "digit": "bigint", "float": "double", "bool": "boolean",
    "time": "timestamp", "object": "map<string,string>", "array": "array<string>",
}


def schema(**fields: str) -> T.StructType:
    """A Spark schema from ``name=type`` pairs of the names above; ``array/digit`` is an array of that type."""
    parts = []
    for name, kind in fields.items():
        spark = f"array<{TYPES[kind[6:]]}>" if kind.startswith("array/") else TYPES[kind]
        parts.append(f"{name} {spark}")
    return T.StructType.fromDDL(", ".join(parts))


def event_time(x: Column, fallback: Column | None = None) -> Column:
    """Timestamp of epoch seconds, milli-, micro- or nanoseconds (told apart by magnitude) or ISO text."""
    text = x.cast("string")
    n = F.expr("1") * F.when(text.rlike(r"^-?\d{1,19}$"), text).try_cast("decimal(20,0)")
    micros = (
        F.when(F.abs(n) < 10**11, n * 10**6).when(F.abs(n) < 10**14, n * 1000).when(F.abs(n) < 10**17, n).otherwise(F.floor(n / 1000))
    ).cast("bigint")
    out = F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(F.when(n.isNull(), text)))
    return F.coalesce(out, fallback) if fallback is not None else out


def conform(df: DataFrame, shape: T.StructType) -> DataFrame:
    """The declared fields in the declared types; missing or unreadable values become null, others go."""
    have = {c.lower() for c in df.columns}
    out = []
    for f in shape.fields:
        kind = f.dataType
        if f.name.lower() not in have:
            c = F.lit(None).cast(kind)
        elif isinstance(kind, T.TimestampType):
            c = event_time(F.col(f.name))
        elif isinstance(kind, (T.MapType, T.ArrayType)) and dict(df.dtypes)[f.name] == "string":
            c = F.from_json(F.col(f.name), kind)
        else:
            c = F.col(f.name).try_cast(kind)
        out.append(c.alias(f.name))
    return df.select(*out)


def infer_time(df: DataFrame, candidates: list[str]) -> Column:
    """``_timestamp`` if there is one, else the first of ``candidates`` with a readable value."""
    names = [c for c in ("_timestamp", *candidates) if c in df.columns]
    return F.coalesce(*[event_time(F.col(c)) for c in names]) if names else F.lit(None).cast("timestamp")
