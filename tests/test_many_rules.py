"""Many rules in one read against each rule by itself."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators.match import Step, any_of
from tallyhawk.plans import rule
from tallyhawk.plans.rule import Rule

KEY, WHO = ("sip",), ("ip", "sip")
RULES = [
    Rule("count", KEY, "1m", (Step("TRUE", 3),), 10, WHO, "kind = 'a'"),
    Rule("kinds", KEY, "2m", (Step("TRUE", 3, "distinct", "port"),), 20, WHO, "kind <> 'b'"),
    Rule("chain", KEY, "3m", (Step("kind = 'a'", 2), Step("kind = 'b'", 1)), 30, WHO, on_fire="once"),
    Rule("any", KEY, "1m", (any_of(Step("kind = 'a'", 4), Step("size > 5", 20, "sum", "size")),), 40, WHO),
    Rule("armed", KEY, "1m", (Step("TRUE", 2),), 50, WHO, "kind = 'b'", "count(*) >= 3 AND avg(size) > 4"),
    Rule("either", KEY, "1m", (Step("TRUE", 3, "distinct", "port"),), 60, WHO, close="max(interval_s) >= 20", close_mode="or"),
    Rule("timed", KEY, "5m", (Step("size > 2", 1),), 70, WHO, close="count(DISTINCT port) >= 3 AND close_reason = 'timeout'"),
    Rule("every", KEY, "2m", (Step("TRUE", 6, "avg", "size"),), 80, WHO, on_fire="every"),
]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice("abc"), rng.randint(0, 9), rng.choice([None, 1.0, 4.5, 9.0]), rng.randint(0, 3000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, sip long, kind string, port int, size double, at long")
    return df.withColumn("ts", F.timestamp_seconds("at")).cache()


def told(df):
    return sorted(map(str, rule.flat(df, "close_reason").collect()))


@pytest.mark.parametrize("options", [{}, {"delay": "5m", "end_reason": None}, {"end_reason": "flush", "late_close": False}], ids=str)
def test_equals_each_rule_alone(events, options):
    # ``run`` gives rules without an "or" close by itself; "either" is held against its two halves.
    parts = [r.with_(close="") if r.name == "either" else r for r in RULES] + [RULES[5].with_(close_mode="and", steps=(Step("TRUE", 1),))]
    want = sorted(x for r in parts for x in told(rule.run(r, events, **options)))
    assert told(rule.run_all(RULES, {r.name: events for r in RULES}, **options)) == want
    assert {x.split("'")[1] for x in want} >= {"count", "kinds", "chain", "any", "every", "either"}


def test_one_exchange_by_key(spark, events):
    shared = rule.together(RULES[:4], events)
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("MapInArrow") == 1 and "Union" not in plan
    with pytest.raises(ValueError):
        rule.together([RULES[0], RULES[1].with_(keys=("kind",), entity=("k", "kind"))], events)


def test_names_choose_rules_and_inputs_stay_apart(spark, events):
    other = events.where("sip = 1")
    inputs = {r.name: other if r.name == "count" else events for r in RULES}
    got = rule.run_all(RULES, inputs, ["count", "kinds"])
    assert told(got) == sorted(told(rule.run(RULES[0], other)) + told(rule.run(RULES[1], events)))
