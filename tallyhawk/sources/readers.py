"""Event sources: files, JDBC tables, Kafka topics, and several of them together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"


@dataclass(frozen=True)
class Source:
    """Where rows come from: ``format`` ndjson, csv, parquet, jdbc or kafka, with the reader's options."""

    name: str
    format: str
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)
    tag: str = ""
    tag_field: str = "stream_tag"
    enabled: bool = True


def read_ndjson(spark: SparkSession, path: str, shape: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are no JSON). Blank lines are neither."""
    wide = T.StructType([*shape.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"), "value")
    good = parsed.where(F.col(f"r.{BAD}").isNull() & F.col("r").isNotNull()).select("r.*").drop(BAD)
    return good, parsed.where(F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull()).select(F.col("value").alias(BAD))


def read_csv(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    return spark.read.schema(shape).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_jdbc(spark: SparkSession, options: dict[str, str], cursor: str = "", start_from: object = None) -> DataFrame:
    """A table or query; with a ``cursor`` only rows past ``start_from``, a filter that the database gets."""
    rows = spark.read.format("jdbc").options(**options).load()
    return rows.where(F.col(cursor) > F.lit(start_from)) if cursor and start_from is not None else rows


def kafka_options(brokers: str, topic: str, group: str = "", offset_reset: str = "earliest") -> dict[str, str]:
    out = {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": offset_reset}
    return out | {"kafka.group.id": group} if group else out


def read_kafka(spark: SparkSession, options: dict[str, str], shape: T.StructType, streaming: bool = True) -> DataFrame:
    """JSON payloads of a topic as rows; needs Spark's Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("kafka").options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), shape).alias("r")).select("r.*")


def read_one(spark: SparkSession, source: Source, shape: T.StructType) -> DataFrame:
    readers = {
        "ndjson": lambda: read_ndjson(spark, source.path, shape)[0],
        "csv": lambda: read_csv(spark, source.path, shape),
        "parquet": lambda: spark.read.options(**source.options).parquet(source.path),
        "jdbc": lambda: read_jdbc(spark, source.options),
        "kafka": lambda: read_kafka(spark, source.options, shape),
    }
    return readers[source.format]()


def read_all(spark: SparkSession, sources: list[Source], shape: T.StructType) -> DataFrame:
    """Rows of all enabled sources, each with its name in ``_source``; a column that one lacks is null there."""
    frames = [read_one(spark, s, shape).withColumn("_source", F.lit(s.name)) for s in sources if s.enabled]
    if not frames:
        return spark.createDataFrame([], T.StructType([*shape.fields, T.StructField("_source", T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def static_table(df: DataFrame, least_rows: int = 0) -> DataFrame:
    """A provider table; raises if it holds fewer rows than it must, so that an empty list never silences rules."""
    if least_rows and len(df.limit(least_rows).take(least_rows)) < least_rows:
        raise ValueError(f"a table of at least {least_rows} rows is asked for")
    return df
