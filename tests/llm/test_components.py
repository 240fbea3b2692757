import random

import pytest

from tallyhawk.llm import components
from tallyhawk.llm.components import connected_components


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_against_search(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "_ONE_TASK", one_task)
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(80)] + [(7, 7), (1, 2), (2, 1)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == near.keys()
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    for g in groups.values():
        todo, seen = [min(g)], {min(g)}
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert seen == g


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_small_tables_are_counted_once_a_round(spark, monkeypatch):
    counted = []
    count = type(spark.range(0)).count
    monkeypatch.setattr(type(spark.range(0)), "count", lambda self: counted.append(count(self)) or counted[-1])
    roots = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    left = [*counted]
    assert count(roots.select("root").distinct()) == 1 and count(roots) == 41
    assert left[0] == 40 and left[-1] == 0 and left == sorted(left, reverse=True)  # the edges left before each round, nothing else
