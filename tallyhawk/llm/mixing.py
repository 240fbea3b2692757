"""Mixing sources to target weights by hierarchical budgeting, in native expressions only.

Documents hang in a tree of domain, language and source. A token budget runs from the root
down: siblings share their parent's budget by weight, no node gets more than its subtree can
give (its tokens times ``max_epochs``), and what a short node leaves is shared among its
siblings first; only when all of them are full does it reach the parent's siblings. All
amounts are whole tokens, so the split is the same on every engine.

A leaf whose budget is e times its tokens and a rest takes e whole epochs and a prefix of
the next: documents in the order of an MD5 of seed, epoch and id, until the rest is spent.
The prefix is found by counting tokens in 256 ranges of that order, again within the range
where the budget ends, and at last document by document within one 65,536th of the leaf,
so no task holds a leaf. What is left is one row a leaf, and choosing is a map over the
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.llm.common import few, written

LEVELS = ("domain", "lang", "source")


def words(text: str) -> Column:
    """Tokens of a text: runs other than space, tab, line feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def weight_of(level: str, weights: dict[str, int], default: int = 1) -> Column:
    """A node's weight by its name among ``weights``."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split ``budget`` among siblings (rows of equal ``parents``) by ``weight`` up to ``capacity``: ``share``.

    By rising capacity per weight, a node is full if giving its rate to all after it stays
    within the budget; the others split what is left.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.col("capacity") / F.col("weight"), name)
    upto, past = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(1, Window.unboundedFollowing)
    used, later = F.sum("capacity").over(upto), F.coalesce(F.sum("weight").over(past), F.lit(0))
    ranked = nodes.withColumn("full", F.col("weight") * (F.col("budget") - used) >= F.col("capacity") * later)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    ranked = ranked.withColumn("spent", spent).withColumn("open", open_)
    part = F.expr("((budget - spent) * weight) div open")
    return ranked.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", part))).drop("full", "spent", "open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (``domain, lang, source, supply``) with their ``share`` of the budget.

    ``weights`` names per level the whole-number weights of nodes; others have 1. Nodes of
    weight 0 take nothing. ``budget`` is worked out over all leaves, such as ``sum(supply)``.
    """
    total = leaves.agg(budget.cast("long").alias("budget"))
    nodes = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    level = None
    for depth, name in enumerate(LEVELS):
        above = list(LEVELS[:depth])
        here = nodes.groupBy(*above, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(name, weights.get(name, {})))
        here = here.where((F.col("weight") > 0) & (F.col("capacity") > 0))
        if level is None:
            here = here.crossJoin(F.broadcast(total))  # one row
        else:
            here = here.join(level.select(*above, F.col("share").alias("budget")), above)
        level = _fill(here, above, name)
    return level.select(*LEVELS, "share").join(nodes.select(*LEVELS, "supply"), list(LEVELS))


def _place(seed: int, epoch: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _part(digit: int) -> Column:
    """The ``digit``-th 256th of the order: two hexadecimal digits."""
    return F.substring("place", 1 + 2 * digit, 2)


def _narrow(docs: DataFrame, digit: int, leaves: int) -> DataFrame:
    """Documents of each of so many ``leaves`` in the 256th where ``rest`` is reached, with what of it is left before them."""
    keys = list(LEVELS)
    sized = docs.withColumn("part", _part(digit))
    sums = sized.groupBy(*keys, "part").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest"))
    before = F.sum("sum").over(Window.partitionBy(*keys).orderBy("part")) - F.col("sum")
    ends = written(sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest"))))
    left = ends.select(*keys, "part", (F.col("rest") - F.col("before")).alias("left"))
    return sized.join(few(left, bound=leaves), [*keys, "part"]).drop("rest", "part").withColumnRenamed("left", "rest")


def plan(slim: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int, seed: int) -> DataFrame:
    """One row a leaf: whole ``epochs``, and where the last one ends: ``cut`` (place), ``cut_tokens`` of that document.

    ``slim`` has ``domain, lang, source, doc_id, tokens``. ``cut`` is null where no part of
    another epoch is left to take.
    """
    keys = list(LEVELS)
    leaves = slim.groupBy(*keys).agg(F.sum("tokens").alias("supply"))
    shares = budgets(written(leaves), weights, budget, max_epochs)
    shares = written(shares.select(*keys, F.expr("cast(share div supply as int)").alias("epochs"), F.expr("share % supply").alias("rest")))
    n = shares.count()
    docs = slim.join(few(shares.where("rest > 0"), bound=n), keys).withColumn("place", _place(seed, F.col("epochs"), "doc_id")).where("tokens > 0")
    for digit in (0, 1):
        docs = _narrow(docs, digit, n)
    order = Window.partitionBy(*keys).orderBy("place")
    start = F.sum("tokens").over(order.rangeBetween(Window.unboundedPreceding, 0)) - F.sum("tokens").over(Window.partitionBy(*keys, "place"))
    last = docs.withColumn("start", start).where(F.col("start") < F.col("rest"))
    cuts = last.groupBy(*keys).agg(
        F.max("place").alias("cut"), F.max_by(F.least("tokens", F.col("rest") - F.col("start")), "place").alias("cut_tokens")
    )
    return written(shares.select(*keys, "epochs").join(cuts, keys, "left"))


def chosen(docs: DataFrame, leaves: DataFrame, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` (with ``domain, lang, source``) once for every epoch that takes them, with ``epoch`` and ``cut_tokens``.

    ``cut_tokens`` is null for a document taken whole, else how many of its first tokens
    the budget takes. Rows that repeat an id in a leaf are taken or left together.
    """
    place = _place(seed, F.col("epochs"), doc_id)
    more = F.col("cut").isNotNull() & (place <= F.col("cut"))
    reach = F.col("epochs") + F.when(more, 1).otherwise(0)
    joined = docs.join(few(leaves), list(LEVELS)).withColumn("epoch", F.explode(F.when(reach > 0, F.sequence(F.lit(0), reach - 1))))
    partial = (F.col("epoch") == F.col("epochs")) & (place == F.col("cut"))
    return joined.withColumn("cut_tokens", F.when(partial, F.col("cut_tokens"))).drop("epochs", "cut")


def _tree(docs: DataFrame, domain: Column, lang: str, source: str) -> list[Column]:
    unknown = F.lit("unknown")
    return [F.coalesce(c, unknown).alias(n) for c, n in zip((domain, F.col(lang), F.col(source)), LEVELS, strict=True)]


def mixed(
    docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int = 2, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, epoch, cut_tokens``: which documents the mixture takes, in which epochs.

    Null domains, languages and sources make the node ``unknown``; a null text has no
    tokens; a leaf without tokens takes nothing. An empty table gives none.
    """
    slim = written(docs.select(*_tree(docs, domain, lang, source), F.col(doc_id).alias("doc_id"), words(text).alias("tokens")))
    leaves = plan(slim, weights, budget, max_epochs, seed)
    return chosen(slim, leaves, seed).select("doc_id", *LEVELS, "tokens", "epoch", "cut_tokens")


def keep_mixed(
    docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int = 2, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """``docs`` as the mixture takes them, repeated where several epochs do; a leaf's last document is cut where the budget ends.

    Nulls and empty tables as in ``mixed``; columns of any name are safe. Only ``text`` is cut.
    """
    slim = written(docs.select(*_tree(docs, domain, lang, source), F.col(doc_id).alias("doc_id"), words(text).alias("tokens")))
    leaves = plan(slim, weights, budget, max_epochs, seed)
    nested = docs.select(F.struct("*").alias("doc"), *_tree(docs, domain, lang, source), F.col(doc_id).alias("doc_id"))
    taken = chosen(nested, leaves, seed)
    # Not more than one document a leaf is cut, so its words are told apart only there.
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("doc")[text], F.lit(r"[ \t\n\r]*[^ \t\n\r]+"), F.lit(0)), F.lit(1), F.col("cut_tokens").cast("int")), "")
    cut = F.when(F.col("cut_tokens").isNotNull(), head).otherwise(F.col("doc")[text])
    return taken.select(*[(cut if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
