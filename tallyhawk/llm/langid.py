"""Language identification by multilingual mixture inference.

Every language has a smoothed distribution over hashed letter n-grams. A document's n-grams
are taken as drawn from an unknown mixture of languages: expectation-maximisation finds the
proportions, then languages leave the set from the smallest proportion up as long as the
likelihood lost is below the penalty for keeping one more. The largest proportion names the
document's language.

Counts come from about ``per_language`` documents of each language, dealt by a hash of the
id, all n-grams of each. Only one dense row of counts for each language reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import dealt
from tallyhawk.llm.grams import word_grams

BITS = 16
_LEAST, _MOST = 3, 3
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    probability: np.ndarray  # [2 ** BITS, languages]
    penalty: float

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of a text with their proportions, largest first; empty for null or letterless text."""
        counts = None
        for bucket, _, _ in word_grams(text or "", _LEAST, _MOST, BITS, letters_only=True):
            some = np.bincount(bucket, minlength=1 << BITS)
            counts = some if counts is None else counts + some
        if counts is None or not self.languages:
            return []
        at = np.nonzero(counts)[0]
        p, n = self.probability[at], counts[at].astype(np.float64)
        keep = np.arange(len(self.languages))
        share, fit = _expectation_maximisation(p, n)
        cost = self.penalty * np.log(1 + n.sum())
        alone = n @ np.log(p)
        if fit - alone.max() <= cost:  # no set of more languages can pay for itself
            return [(self.languages[int(alone.argmax())], 1.0)]
        while len(keep) > 1:
            least = int(share.argmin())
            rest = np.delete(keep, least)
            fewer, less = _expectation_maximisation(p[:, rest], n)
            if fit - less > cost:
                break
            keep, share, fit = rest, fewer, less
        order = np.lexsort((keep, -share))
        return [(self.languages[keep[k]], float(share[k])) for k in order]


def _expectation_maximisation(p: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    share = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] == 1:
        return share, float(n @ np.log(p[:, 0]))
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / n.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def _count(t: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << BITS, np.int64)
    for text in t["text"]:
        for bucket, _, _ in word_grams(text, _LEAST, _MOST, BITS, letters_only=True):
            total += np.bincount(bucket, minlength=1 << BITS)
    return pd.DataFrame({"lang": [t["lang"].iat[0]], "counts": [total.tobytes()]})


def _add(t: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in t["counts"])
    return pd.DataFrame({"lang": [t["lang"].iat[0]], "counts": [total.tobytes()]})


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500, penalty: float = 12.0, most_languages: int = 64) -> Model:
    """n-gram distributions of the non-null languages among the documents of ``learn``.

    A dirty label column may hold any number of values; the ``most_languages`` with most
    documents (ties: first name) are learnt, which bounds what reaches the driver and tasks.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Model((), np.zeros((1 << BITS, 0)), penalty)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, per_language / n)]), F.col("lang"))
    some = known.where(dealt(F.col("id"), 3) < share).withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(64)))
    counts = some.groupBy("lang", "lot").applyInPandas(_count, "lang string, counts binary").groupBy("lang").applyInPandas(_add, "lang string, counts binary")
    got = sorted((r.lang, np.frombuffer(r.counts, np.int64)) for r in counts.collect())
    if not got:
        return Model((), np.zeros((1 << BITS, 0)), penalty)
    table = np.stack([c for _, c in got], axis=1).astype(np.float64)
    pooled = (table.sum(axis=1, keepdims=True) + 0.5) / (table.sum() + 0.5 * len(table))
    smooth = 0.02 * len(table)
    return Model(tuple(k for k, _ in got), (table + smooth * pooled) / (table.sum(axis=0) + smooth), penalty)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``mixture`` (language, share), ``lang_pred`` and ``score``, the share of ``lang_pred``.

    A null text, one without letters, or a model without languages gives an empty mixture,
    ``und`` and score 0.
    """

    @F.pandas_udf("array<struct<language string, share double>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"language": k, "share": v} for k, v in model.mixture(t)] for t in texts])

    named = docs.withColumn("mixture", of(F.col(text)))
    top = F.get("mixture", F.lit(0))
    return named.withColumn("lang_pred", F.coalesce(top["language"], F.lit(UNKNOWN))).withColumn("score", F.least(F.coalesce(top["share"], F.lit(0.0)), F.lit(1.0)))
