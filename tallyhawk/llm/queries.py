"""The registered queries of the training-data operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.llm import (
    ann, bpe, chat, clustering, clustering_sql, embedding_neardup, langid, license_scan, mixing, mixing_sql, packing, pii, prefix_trie, prefix_trie_sql, simhash, toxicity,
)
from tallyhawk.llm.common import doc_crc, read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Domains of the sources, target weights of the tree's nodes, and the rest of the mixture's parameters.
CRAWL, REFERENCE = ("src0",), tuple(f"src{i}" for i in range(1, 10))
WEIGHTS = {"domain": {"crawl": 2, "reference": 5, "community": 3}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
MAX_EPOCHS, MIX_SEED = 2, 7

CLUSTERS = {"k": 8, "rounds": 10, "dim": 64, "scale": 1024, "seed": 3}

#: The conversation that says control strings, to show that they come back as text.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def domain_of() -> Column:
    return F.when(F.col("source").isin(*CRAWL), "crawl").when(F.col("source").isin(*REFERENCE), "reference").when(F.col("source").isNotNull(), "community")


def mix_budget() -> Column:
    """Three fifths of all tokens."""
    return F.expr("sum(supply) * 3 div 5")


def learns_toxicity() -> Column:
    return doc_crc(F.col("doc_id"), 3) != 1


def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as power-of-two pieces, each a sequence of its own."""
    return packing.digest(read(spark, sf_dir, "documents"), VOCABULARY, longest=2048)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return embedding_neardup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from four folds of five."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = doc_crc(F.col("doc_id"), 5)
    model = langid.fit(docs, fold != 0)
    return langid.predicted(docs.drop("lang"), model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth embedding among all others."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, rendered turn by turn and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    return chat.digest(rows.unionByName(control))


def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed formats, and what their contexts vouch for."""
    return pii.digest(read(spark, sf_dir, "documents"))


def op7_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a mixture of all sources takes, in which epochs."""
    return mixing.mixed(read(spark, sf_dir, "documents"), domain_of(), WEIGHTS, mix_budget(), MAX_EPOCHS, MIX_SEED)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named in all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.fit(docs))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all documents."""
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels of two folds of three."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), learns_toxicity())
    held = F.coalesce(doc_crc(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, whose first turns are those of the hundred's first."""
    return prefix_trie.trie(prefix_trie.with_shared_starts(prefix_trie.turn_lists(read(spark, sf_dir, "conversations")), every=100, modulus=6))


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the texts they decode to, as hashes."""
    return bpe.digest(read(spark, sf_dir, "documents"), VOCABULARY)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return clustering.clustered(read(spark, sf_dir, "embeddings"), **CLUSTERS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_binary_packing, op2_embedding_neardup, op3_language_mixture, op4_prefix_forest, op5_chat_spans, op6_contextual_pii,
        op7_hierarchical_mixing, op8_license_scan, op9_simhash_neardup, op10_subword_toxicity, op11_prefix_trie, op12_backtracking_bpe,
        op13_centroid_clusters,
    )
}

_DOMAIN_SQL = (
    f"CASE WHEN source IN ({', '.join(repr(x) for x in CRAWL)}) THEN 'crawl' WHEN source IN ({', '.join(repr(x) for x in REFERENCE)}) THEN 'reference' "
    "WHEN source IS NOT NULL THEN 'community' ELSE 'unknown' END"
)

_NEAR_COPIES_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usual AS (SELECT len(e) AS n FROM vectors WHERE len(e) > 0 GROUP BY len(e) ORDER BY count(*) DESC, n DESC LIMIT 1),
good AS (SELECT vec_id, e FROM vectors WHERE len(e) = (SELECT n FROM usual) AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM vectors UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""

#: The default template adds 24 characters a turn and a backslash to each run of ``<``, backslashes and ``|`` in role and text.
_CHAT_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '{CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) c(t, r)),
sized AS (SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS told FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(told) + length(text) + len(regexp_extract_all(told, '<\\\\*[|]')) + len(regexp_extract_all(text, '<\\\\*[|]'))) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op2_embedding_neardup": _NEAR_COPIES_SQL,
    "op5_chat_spans": _CHAT_SQL,
    "op7_hierarchical_mixing": mixing_sql.mixture(_DOMAIN_SQL, WEIGHTS, "CAST(sum(supply) * 3 AS BIGINT) // 5", MAX_EPOCHS, MIX_SEED),
    "op11_prefix_trie": prefix_trie_sql.trie(every=100, modulus=6),
    "op13_centroid_clusters": clustering_sql.clusters(**CLUSTERS),
}
