"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a written table that may be broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (as in tests) gets one of its own; on a cluster that
    would be a folder that driver and executors do not share, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: ``df`` as a Parquet table in the shared folder, read back.

    Unlike ``DataFrame.checkpoint`` this gives the table's true size to the planner. A
    checkpoint keeps the estimate of the plan it came from, and estimates of joins multiply:
    over rounds of joins they grow to numbers that the driver can no longer work out.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def released(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = MOST_BROADCAST, bound: int | None = None) -> DataFrame:
    """A written table marked for broadcast if it has few enough rows, else left to a shuffle.

    It is counted unless ``bound``, which its rows are known not to pass, is few enough: a
    count is a job, and of every job something stays in the driver.
    """
    return F.broadcast(df) if (bound is not None and bound <= most) or df.count() <= most else df


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in Arrow batches of so many rows: ten thousand take tens of MB on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    if table == "documents":
        text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_crc(doc_id: Column, modulus: int) -> Column:
    """The fold of a document: CRC-32 of its id written as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def dealt(doc_id: Column, salt: int) -> Column:
    """A number from 0 up to 1 by a hash of the id: rows below ``n / count`` are about ``n`` rows, however many tasks choose them."""
    return F.pmod(F.xxhash64(F.lit(salt), doc_id), F.lit(1 << 30)) / float(1 << 30)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
