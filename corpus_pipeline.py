"""A training corpus from ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.llm import mixing, packing, pii, queries, simhash_confirmed, toxicity
from tallyhawk.llm.common import read, text_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by a model learnt from the labels; null and empty texts take the score of no evidence. An empty table stays empty."""
    text_batches(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), queries.learns_toxicity())
    return toxicity.keep_clean(docs, model, threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-copies by five-word shingles, each link confirmed at a similarity of 0.8; one document of each group stays.

    Rows without an id stay; null, empty and wordless texts are copies of each other.
    """
    text_batches(spark)
    return simhash_confirmed.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; the length follows the text. Null texts stay null."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three fifths of the tokens, by the weights of domains and languages; a leaf's last document is cut where its budget ends.

    Null languages and sources are leaves ``unknown``; a leaf without tokens takes nothing.
    """
    mixed = mixing.keep_mixed(docs, queries.domain_of(), queries.WEIGHTS, queries.mix_budget(), queries.MAX_EPOCHS, queries.MIX_SEED)
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences to train on: pieces of a power of two of token ids, with their checksums. A null text is one closing token."""
    text_batches(spark)
    # Workers outlive the stage, so words are remembered by fewer than where packing is all there is to do.
    return packing.packed(docs, queries.VOCABULARY, longest=2048, remembered=150_000).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashing, learning and tokenizing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each on the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
