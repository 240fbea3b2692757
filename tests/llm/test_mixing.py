import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from tallyhawk.llm import mixing

WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"x": 2}}


def split(budget, nodes, depth=0):
    """Plain water-filling: {leaf: tokens} for {leaf: supply}, largest share first cut to capacity."""
    if depth == 3:
        return {leaf: budget for leaf in nodes}
    kids = {}
    for leaf, cap in nodes.items():
        kids.setdefault(leaf[depth], {})[leaf] = cap
    weight = {k: WEIGHTS.get(mixing.LEVELS[depth], {}).get(k, 1) for k in kids}
    share, open_ = {}, {k for k in kids if sum(kids[k].values())}
    left = budget
    while True:
        total = sum(weight[k] for k in open_)
        full = [k for k in open_ if Fraction(left * weight[k], total) >= sum(kids[k].values())]
        if not full:
            break
        k = min(full, key=lambda k: Fraction(sum(kids[k].values()), weight[k]))
        share[k] = sum(kids[k].values())
        left -= share[k]
        open_.discard(k)
    for k in open_:
        share[k] = left * weight[k] // sum(weight[j] for j in open_)
    out = {}
    for k, s in share.items():
        out |= split(s, kids[k], depth + 1)
    return out


def test_against_plain_version(spark):
    rows = []
    for i in range(300):
        leaf = [("a", "x", "s1"), ("a", "x", "s2"), ("a", "y", "s3"), ("b", "x", "s1"), ("b", "z", None), (None, "x", "s4")][min(i % 11, 5)]
        rows.append((i, "w " * (i * 7 % 23), *leaf))
    rows += [(400, None, "a", "x", "s1"), (5, rows[5][1], *rows[5][2:]), (None, "k k", "b", "x", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, source string")
    for num, epochs in ((1, 1), (3, 2), (9, 3)):
        got = mixing.mixed(docs, F.col("dom"), WEIGHTS, F.expr(f"sum(supply) * {num} div 5"), epochs, seed=3).collect()
        members = {}
        for i, t, *leaf in rows:
            members.setdefault(tuple(x or "unknown" for x in leaf), []).append((i, len((t or "").split())))
        supply = {k: sum(n for _, n in v) for k, v in members.items()}
        want = []
        for leaf, share in split(sum(supply.values()) * num // 5, {k: v * epochs for k, v in supply.items()}).items():
            whole, rest = divmod(share, supply[leaf])
            want += [(i, *leaf, n, e, None) for e in range(whole) for i, n in members[leaf]]
            place = lambda d: hashlib.md5(f"3:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest()  # noqa: B023, E731
            at, cut = 0, []
            for i, n in sorted(members[leaf], key=place):
                if at >= rest:
                    break
                cut.append([i, *leaf, n, whole, None, at])
                at += n
            spent = [c for c in cut if c[4]]
            if spent:
                first = min(c[7] for c in spent if c[0] == spent[-1][0])
                for c in spent:
                    if c[0] == spent[-1][0]:
                        c[6] = min(c[4], rest - first)
            want += [tuple(c[:7]) for c in cut]
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    kept = mixing.keep_mixed(docs, F.col("dom"), WEIGHTS, F.expr("sum(supply) * 9 div 5"), 3, seed=3)
    assert kept.columns == docs.columns and kept.count() == len(got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mixed(docs, F.lit("a"), {}, F.expr("sum(supply) div 2")).count() == 0
