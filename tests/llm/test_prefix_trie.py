import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyhawk.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, head long"


def run(spark, rows, most):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    lists = prefix_trie.with_shared_starts(prefix_trie.turn_lists(df))
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in prefix_trie.trie(lists, most).collect()}


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = (*said.get(c - c % 100, [])[:h], *own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = {}
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) > len(p) and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in inside if len(rebuilt[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out[min(inside), len(path)] = (parent, len(inside), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [1, 12, 1 << 15])
def test_nodes_equal_plain_search(spark, most):
    rng = random.Random(most)
    rows = []
    for c in [*range(60), *range(200, 230), 317, 318, 100_000, 70_000_000_000]:
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", "é👍", None])))
    rows += [(500 + k, t, "user", f"long {t}") for k in range(40) for t in range(20 + k % 3)]  # many share twenty turns
    rng.shuffle(rows)
    assert run(spark, rows, most) == brute(rows)


def test_null_turns_ids_and_ties(spark):
    rows = [(0, None, "user", "b"), (0, 0, "user", "a"), (None, 0, "user", "lost"), (150, 0, None, None), (7, 1, "user", "x"), (7, 1, "user", "x")]
    got = run(spark, rows, 4)
    assert got == brute(rows)
    assert got[0, 0][1] == 3


def test_no_conversations(spark):
    assert run(spark, [], 4) == {} and run(spark, [(None, 0, "user", "a")], 4) == {}


def test_conversations_without_turns_end_at_the_root(spark):
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(gone, 0, "user", "a")]
    assert run(spark, rows, 4) == brute(rows) == {(gone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())}
