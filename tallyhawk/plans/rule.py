"""A detection as data: what it reads, how it matches, what it says. Run on DataFrames, or told as DuckDB SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.operators import alerts, match
from tallyhawk.operators.match import Step
from tallyhawk.operators.windows import START, micros, seconds, stretches, unused
from tallyhawk.plans import sql


@dataclass(frozen=True)
class Rule:
    """``keys`` in anchored windows of ``dur`` over the events where ``where`` holds.

    Without ``close`` every completion of ``steps`` is an alert. ``close`` is a condition on
    aggregates of the window's events, on ``close_reason`` (timeout, eos, flush) and on
    ``interval_s``, the seconds since the window's event before. With ``close_mode`` and, a completed chain only arms:
    one alert when the window closes, if the condition holds. With or, completions alert at
    once and the condition is judged by itself when the window closes. ``entity`` is a type
    and one of the keys.
    """

    name: str
    keys: tuple[str, ...]
    dur: str
    steps: tuple[Step, ...]
    score: float
    entity: tuple[str, str]
    where: str = "TRUE"
    close: str = ""
    close_mode: str = "and"
    on_fire: str = "reset"

    def with_(self, **changes) -> Rule:
        return replace(self, **changes)


def run(
    rule: Rule, events: DataFrame, ts: str = "ts", order: str = "event_id", delay: str = "0s", end_reason: str | None = "eos", late_close: bool = True, split: bool = False
) -> DataFrame:
    """Alerts of ``rule`` with the firing measure in ``measure`` (null for closings).

    Windows that end ``delay`` before the latest event of the rule's input or earlier close
    by timeout, the rest for ``end_reason``. ``split`` deals a key's rows to several tasks,
    for keys with very many rows: those of a single count in blocks, others wherever the key
    pauses for a whole window.
    """
    if rule.close and rule.close_mode == "or" and not split:
        return together([rule], events, ts, order, delay, end_reason, late_close)
    rows, steps = bound(rule, events, ts, order)
    keys, parts, hot = list(rule.keys), None, split and len(steps) == 1 and steps[0].measure == "count"
    if split and not hot:
        parts = [unused(rows.columns, "_part")]
        rows = stretches(rows, keys, ts, rule.dur, parts[0])
    tracked = match.track(rows, keys, ts, order, rule.dur, steps, rule.on_fire, parts, hot)
    windows = match.with_reason(tracked, rule.dur, match.watermark_of(rows, ts, delay) if late_close else None, end_reason) if rule.close else None
    return told(rule, tracked, windows, ts, order)


def bound(rule: Rule, events: DataFrame, ts: str, order: str) -> tuple[DataFrame, list[Step]]:
    """The rule's events with the columns that matching, alerts and the close look at, and the steps told by them."""
    named = [c for c in events.columns if re.search(rf"\b{re.escape(c)}\b", rule.close)]
    return match.slimmed(events.where(rule.where), [*rule.keys, rule.entity[1], ts, order, *named], list(rule.steps))


def told(rule: Rule, tracked: DataFrame, windows: DataFrame | None, ts: str, order: str) -> DataFrame:
    """Alerts of tracked rows that fire, and of windows, given by their rows with ``close_reason``, as they close."""
    keys, entity, out = list(rule.keys), (rule.entity[0], F.col(rule.entity[1])), []
    if not rule.close or rule.close_mode == "or":
        out.append(alerts.envelope(match.firings(tracked), rule.name, entity, rule.score, F.col(ts), measure=F.col(match.VALUE)))
    if rule.close:
        if re.search(r"\binterval_s\b", rule.close):
            windows = match.with_interval(windows, keys, ts, order)
        seen = match.evidence(windows, keys, ts, order, rule.dur, F.expr(rule.close).alias("holds"))
        armed = F.col("holds") & (F.col("matches") > 0) if rule.close_mode == "and" else F.col("holds")
        closed = match.closings(seen, armed)
        out.append(alerts.envelope(closed, rule.name, entity, rule.score, F.col("fired_at"), F.concat(F.lit("close:"), F.col("close_reason")), measure=F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, out)


def oracle(rule: Rule, source: str, delay: str = "0s", end_reason: str | None = "eos", name: str = "w") -> str:
    """The alerts of ``run`` as SQL over ``source``, columns as ``flat`` has them."""
    bound = f"SELECT * FROM ({source}) WHERE {rule.where}"
    steps = list(rule.steps)
    if len(steps) == 1 and steps[0].measure == "count":
        bound += f" AND coalesce({steps[0].flag}, FALSE)"
    watermark = f"(SELECT max(ts) FROM ({bound})) - INTERVAL {seconds(delay)} SECOND"
    ctes = sql.chain(bound, list(rule.keys), rule.dur, steps, rule.on_fire, name=name)
    head = f"SELECT '{rule.name}' AS rule_name, CAST({rule.score} AS DOUBLE) AS score, '{rule.entity[0]}' AS entity_type, CAST({rule.entity[1]} AS VARCHAR) AS entity_id"
    parts = []
    if not rule.close or rule.close_mode == "or":
        parts.append(f"{head}, 'event' AS origin, {sql.us('ts')} AS fired_at_us, round(measure, 4) AS measure FROM {name} WHERE fired")
    if rule.close:
        k = ", ".join(rule.keys)
        end = f"window_start + INTERVAL {seconds(rule.dur)} SECOND"
        armed = "armed AND holds" if rule.close_mode == "and" else "holds"
        gap = f"({sql.us('ts')} - lag({sql.us('ts')}) OVER (PARTITION BY {k}, window_start ORDER BY ts, event_id)) / 1e6"
        rows = f"SELECT *, {gap} AS interval_s, CASE WHEN {end} <= {watermark} THEN 'timeout' ELSE {repr(end_reason) if end_reason else 'NULL'} END AS close_reason FROM {name} WHERE window_start IS NOT NULL"
        parts.append(
            f"{head}, 'close:' || close_reason AS origin, CASE WHEN close_reason = 'timeout' THEN {sql.us(end)} ELSE {sql.us('last')} END AS fired_at_us, CAST(NULL AS DOUBLE) AS measure "
            f"FROM (SELECT {k}, window_start, close_reason, bool_or(fired) AS armed, coalesce({rule.close}, FALSE) AS holds, max(ts) AS last "
            f"FROM ({rows}) GROUP BY {k}, window_start, close_reason) WHERE {armed} AND close_reason IS NOT NULL"
        )
    return ctes + " " + " UNION ALL ".join(parts)


def flat(found: DataFrame, *more: str | Column) -> DataFrame:
    """Alerts as compared with SQL: no emission time, times as microseconds, the measure rounded."""
    return found.select("rule_name", "score", "entity_type", "entity_id", "origin", micros("fired_at").alias("fired_at_us"), F.round("measure", 4).alias("measure"), *more)


def together(
    rules: list[Rule], events: DataFrame, ts: str = "ts", order: str = "event_id", delay: str = "0s", end_reason: str | None = "eos", late_close: bool = True
) -> DataFrame:
    """Alerts of rules of the same keys over the same events, as ``run`` gives them, in one pass.

    The events are dealt by key once, and one read follows the chains of all rules. Firings
    and the rows of windows that a rule judges as they close then go through one
    aggregation, in which a firing is a group of its own.
    """
    keys = list(rules[0].keys)
    if any(list(r.keys) != keys for r in rules):
        raise ValueError("rules told together have the same keys")
    named = [c for c in events.columns if any(re.search(rf"\b{re.escape(c)}\b", r.close) for r in rules)]
    own = [[_within(s, r.where) for s in r.steps] for r in rules]
    rows, steps = match.slimmed(events, [*keys, ts, order, *named], [s for some in own for s in some])
    at, chains = iter(steps), []
    for r in rules:
        chains.append(match.Chain(tuple(next(at) for _ in r.steps), r.dur, r.on_fire, "windows" if r.close else "fired"))
    tracked = match.track_all(rows, keys, ts, order, chains)
    chain, start, fires = F.col(match.CHAIN), F.col(START), [not r.close or r.close_mode == "or" for r in rules]

    def by_rule(told: list[Column], only: list[bool] | None = None) -> Column:
        out = None
        for i, c in enumerate(told):
            if only is None or only[i]:
                out = F.when(chain == i, c) if out is None else out.when(chain == i, c)
        return out if out is not None else F.lit(None)

    closes = [bool(r.close) for r in rules]
    ends = start + F.make_dt_interval(secs=by_rule([F.lit(seconds(r.dur)) for r in rules]))
    if any(closes):
        tracked = tracked.withColumn("close_reason", F.lit(end_reason).cast("string"))
        if late_close:
            marks = events.agg(*[F.max(F.when(F.expr(r.where), F.col(ts))).alias(f"_mark{i}") for i, r in enumerate(rules)])
            mark = by_rule([F.col(f"_mark{i}") for i in range(len(rules))]) - F.make_dt_interval(secs=F.lit(seconds(delay)))
            tracked = tracked.join(F.broadcast(marks)).withColumn("close_reason", F.when(ends <= mark, "timeout").otherwise(F.col("close_reason"))).drop(*marks.columns)  # one row
        if any(re.search(r"\binterval_s\b", r.close) for r in rules):
            tracked = match.with_interval(tracked, [match.CHAIN, *keys], ts, order)
    firing = F.array(*[F.struct(F.lit("event").alias("kind"), F.monotonically_increasing_id().alias("one"))])
    window = F.array(F.struct(F.lit("close").alias("kind"), F.lit(-1).cast("long").alias("one")))
    none = F.array().cast("array<struct<kind:string,one:bigint>>")
    kinds = F.concat(
        F.when(F.col(match.FIRED) & chain.isin([i for i, f in enumerate(fires) if f]), firing).otherwise(none) if any(fires) else none,
        F.when(chain.isin([i for i, c in enumerate(closes) if c]), window).otherwise(none) if any(closes) else none,
    )
    reason = ["close_reason"] if any(closes) else []
    groups = tracked.withColumn("_k", F.explode(kinds)).groupBy(match.CHAIN, "_k.kind", "_k.one", *keys, START, *reason).agg(
        F.max(ts).alias("last_event"), F.max(match.VALUE).alias("measure"), F.count_if(match.FIRED).alias("matches"),
        F.coalesce(by_rule([F.expr(r.close or "FALSE") for r in rules], closes).cast("boolean"), F.lit(False)).alias("holds"),
    )
    event, armed = F.col("kind") == "event", by_rule([F.lit(r.close_mode == "or") for r in rules]) | (F.col("matches") > 0)
    ended = F.col("close_reason") if reason else F.lit(None).cast("string")
    kept = groups.where(event | (F.col("holds") & armed & ended.isNotNull()))
    at_end = F.when(ended == "timeout", ends).otherwise(F.col("last_event"))
    told = alerts.envelope(
        kept, "", ("", by_rule([F.col(r.entity[1]).cast("string") for r in rules])), by_rule([F.lit(float(r.score)) for r in rules]), F.when(event, F.col("last_event")).otherwise(at_end),
        F.when(event, "event").otherwise(F.concat(F.lit("close:"), ended)), measure=F.when(event, F.col("measure")), chain=chain,
    )
    return told.withColumn("rule_name", by_rule([F.lit(r.name) for r in rules])).withColumn("entity_type", by_rule([F.lit(r.entity[0]) for r in rules])).drop(match.CHAIN)


def _within(step: Step, where: str) -> Step:
    """``step`` over the events where ``where`` holds."""
    if step.either:
        return match.any_of(*[_within(t, where) for t in step.either])
    return replace(step, when=f"({where}) AND ({step.when})")


def run_all(rules: list[Rule], inputs: dict[str, DataFrame], names: list[str] | None = None, **options) -> DataFrame:
    """Alerts of the rules (those of ``names``, if given), each on its input; those that share an input and keys are read together."""
    shared: dict[tuple, list[Rule]] = {}
    for r in rules:
        if names is None or r.name in names:
            shared.setdefault((id(inputs[r.name]), r.keys), []).append(r)
    return reduce(DataFrame.unionByName, [together(some, inputs[some[0].name], **options) for some in shared.values()])


def ordered(reads: dict[str, set[str]]) -> list[str]:
    """Rules in an order in which each comes after those whose alerts it reads; a cycle is an error."""
    return list(TopologicalSorter(reads).static_order())


def alerts_as_events(found: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Alerts in the shape of events for a following rule: ``ts`` is the firing time, ids are by time and entity."""
    return found.select(F.col("fired_at").alias("ts"), F.concat_ws(":", "entity_id", micros("fired_at")).alias("event_id"), *[c.alias(k) for k, c in keys.items()], "rule_name", "score", "origin")


__all__ = ["START", "Rule", "Step", "alerts_as_events", "flat", "oracle", "ordered", "run", "run_all"]
