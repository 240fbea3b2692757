"""Expected against actual alerts within tolerances, and how well rules detect.

Alerts meet by rule, entity and origin. Within such a group each expected alert, in order of
time and score, takes the nearest actual one not taken yet (of equally near ones the earlier,
then the one of lower score). Both sides are one table dealt by key. A key with at most one
alert on each side is paired by an aggregation. The others are sorted by time and read once:
expected alerts wait for the next actual one, and actual ones that nobody took lie on a
stack whose top is the nearest before. What is held is the waiting and the left-over alerts
of one key, not the key's alerts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.operators.alerts import PREFIX

KEY = ["rule_name", "entity_type", "entity_id", "origin"]
SCORE_TOLERANCE, TIME_TOLERANCE_S = 0.01, 1.0


def plain(alerts: DataFrame) -> DataFrame:
    """Either shape (plain or meta-prefixed names) as key, score and time (firing, else emission), flush counting as end of stream."""
    def pick(name: str) -> Column:
        have = [F.col(c) for c in (name, PREFIX + name) if c in alerts.columns]
        return F.coalesce(*have) if have else F.lit(None)

    origin = F.when(pick("origin") == "close:flush", "close:eos").otherwise(pick("origin").cast("string"))
    return alerts.select(
        pick("rule_name").cast("string").alias("rule_name"), pick("entity_type").cast("string").alias("entity_type"), pick("entity_id").cast("string").alias("entity_id"),
        origin.alias("origin"), pick("score").cast("double").alias("score"), F.coalesce(pick("fired_at").cast("timestamp"), pick("emit_time").cast("timestamp")).alias("at"),
    )


class _Pairing:
    """Pairs of one key: actual alerts are given by time, those of one time together, expected ones by time after them."""

    def __init__(self):
        self.waiting: list[tuple[int, float]] = []  # expected (time, score) later than every actual one but those on the stack
        self.left: list[tuple[int, float]] = []  # actual, nearest on top
        self.pairs: list[tuple] = []

    def expect(self, t: int, score) -> None:
        self.waiting.append((t, score))

    def meet(self, t: int, scores: list) -> None:
        """Actual alerts of time ``t``, lowest score first."""
        taken = 0
        for at, (e, score) in enumerate(self.waiting):
            if self.left and e - self.left[-1][0] <= t - e:
                self.pairs.append((e, score, *self.left.pop()))
            elif taken < len(scores):
                self.pairs.append((e, score, t, scores[taken]))
                taken += 1
            else:
                self.waiting = self.waiting[at:]
                return
        self.waiting = []
        self.left += [(t, s) for s in reversed(scores[taken:])]

    def end(self) -> None:
        for e, score in self.waiting:
            self.pairs.append((e, score, *(self.left.pop() if self.left else (None, None))))
        self.pairs += [(None, None, *a) for a in self.left]
        self.waiting, self.left = [], []


_OUT = [("expected_at", pa.int64()), ("expected_score", pa.float64()), ("actual_at", pa.int64()), ("actual_score", pa.float64())]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(k, pa.string()) for k in KEY] + _OUT)
    key, pairing, same = None, _Pairing(), None  # same: the time whose actual alerts are being gathered, and their scores
    out: list[tuple] = []

    def told() -> None:
        out.extend((*key, *p) for p in pairing.pairs)
        pairing.pairs = []

    for batch in batches:
        for *own, expected, t, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                if key is not None:
                    if same:
                        pairing.meet(*same)
                    pairing.end()
                    told()
                key, same = own, None
            if same and (expected or t != same[0]):
                pairing.meet(*same)
                same = None
            if expected:
                pairing.expect(t, score)
            else:
                same = same or (t, [])
                same[1].append(score)
        if key is not None:
            told()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    if key is not None:
        if same:
            pairing.meet(*same)
        pairing.end()
        told()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def reconcile(expected: DataFrame, actual: DataFrame, score_tolerance: float = SCORE_TOLERANCE, time_tolerance_s: float = TIME_TOLERANCE_S) -> DataFrame:
    """One row per pair or leftover: key, ``status`` (matched, field_mismatch, missing, unexpected), both scores and times.

    A null in a key equals a null; a null time counts as the epoch, a null score agrees with none.
    """
    sides = [
        plain(side).select(*KEY, F.lit(name == "expected").alias("expected"), F.coalesce(F.unix_micros("at"), F.lit(0)).alias("t"), "score")
        for name, side in (("expected", expected), ("actual", actual))
    ]
    of_key = Window.partitionBy(*KEY)
    counts = [F.count_if(c).over(of_key).alias(n) for n, c in (("_e", F.col("expected")), ("_a", ~F.col("expected")))]
    dealt = sides[0].unionByName(sides[1]).repartition(*KEY).select("*", *counts)
    alone = (F.col("_e") <= 1) & (F.col("_a") <= 1)
    one = lambda c, side: F.max(F.when(F.col("expected") == side, F.col(c)))
    single = dealt.where(alone).groupBy(*KEY).agg(one("t", True).alias("expected_at"), one("score", True).alias("expected_score"), one("t", False).alias("actual_at"), one("score", False).alias("actual_score"))
    crowded = dealt.where(~alone).drop("_e", "_a").sortWithinPartitions(*KEY, "t", "expected", "score")
    shape = ", ".join(f"{k} string" for k in KEY) + ", expected_at long, expected_score double, actual_at long, actual_score double"
    pairs = single.unionByName(crowded.mapInArrow(_paired, shape))
    within = (F.abs(F.col("expected_score") - F.col("actual_score")) <= score_tolerance) & (F.abs(F.col("expected_at") - F.col("actual_at")) <= time_tolerance_s * 1e6)
    status = F.when(F.col("actual_at").isNull(), "missing").when(F.col("expected_at").isNull(), "unexpected").when(F.coalesce(within, F.lit(False)), "matched").otherwise("field_mismatch")
    times = [F.timestamp_micros(c).alias(c) for c in ("expected_at", "actual_at")]
    return pairs.select(*KEY, status.alias("status"), "expected_score", "actual_score", *times)


def report(pairs: DataFrame) -> DataFrame:
    """One row: how many pairs of each status, totals of both sides, and whether all agree."""
    n = {s: F.count_if(F.col("status") == s) for s in ("matched", "missing", "unexpected", "field_mismatch")}
    return pairs.agg(
        *[c.alias(s) for s, c in n.items()], (n["matched"] + n["missing"] + n["field_mismatch"]).alias("expected_total"), (n["matched"] + n["unexpected"] + n["field_mismatch"]).alias("actual_total"),
        (n["missing"] + n["unexpected"] + n["field_mismatch"] == 0).alias("passed"),
    )


def quality(labels: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rates per rule from ``labels`` (rule_name, entity_id, case: hit, near_miss or miss, last_evidence).

    An entity is alerted if its rule has an alert for it. hit, near_miss and miss are the
    alerted shares of those cases; precision is the hits' share of alerted entities, fpr the
    alerted share of all that are no hits; latency runs from the last evidence to the first
    alert, in seconds.
    """
    first = alerts.groupBy("rule_name", "entity_id").agg(F.min("fired_at").alias("fired_at"))
    seen = labels.join(first, ["rule_name", "entity_id"], "left").withColumn("alerted", F.col("fired_at").isNotNull())

    def share(part: Column, of: Column) -> Column:
        return F.try_divide(F.count_if(part & of).cast("double"), F.count_if(of).cast("double"))

    hit, alerted = F.col("case") == "hit", F.col("alerted")
    latency = (F.unix_micros("fired_at") - F.unix_micros("last_evidence")) / 1e6
    return seen.groupBy("rule_name").agg(
        share(alerted, hit).alias("hit"), share(alerted, F.col("case") == "near_miss").alias("near_miss"), share(alerted, F.col("case") == "miss").alias("miss"),
        share(hit, alerted).alias("precision"), share(alerted, hit).alias("recall"), share(alerted, ~hit).alias("fpr"),
        F.percentile(F.when(alerted & hit, latency), F.lit(0.95)).alias("latency_p95"),
    )


def checks(rates: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """``rule_name, metric, value, op, bound, passed`` for bounds like ("hit", ">=", 0.95); a missing value fails."""
    ops = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(op).alias("op"), F.lit(float(b)).alias("bound"), F.coalesce(ops[op](F.col(m), b), F.lit(False)).alias("passed"))
        for m, op, b in bounds
    ]
    return rates.select("rule_name", F.explode(F.array(*rows)).alias("c")).select("rule_name", "c.*")


def counts_against(alerts: DataFrame, expected: DataFrame) -> DataFrame:
    """``rule_name, expected, actual, passed`` for a table of expected alert counts."""
    got = alerts.groupBy("rule_name").agg(F.count(F.lit(1)).alias("actual"))
    both = expected.join(got, "rule_name", "full").select("rule_name", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.withColumn("passed", F.col("expected") == F.col("actual"))
