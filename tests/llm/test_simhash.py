import random

import numpy as np
import xxhash

from tallyhawk.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, radius):
    least = {}
    ids = sorted(pairs)
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            near = [y for y in ids if y not in seen and (pairs[x] ^ pairs[y]).bit_count() <= radius]
            seen.update(near)
            todo += near
        least[i] = min(seen)
    return least


def test_fingerprint_of_whole_text():
    for text in [None, "", " \n", "One", "one TWO", "Él ÉTÉ Ab cD", "a b c a b c\x0bd  e f"] + ["w%d " % i * (i % 3 + 1) for i in range(50)]:
        assert simhash.fingerprint_bytes(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_group_forest_and_cross_links_against_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.array([base[rng.integers(40)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(400)])
    group = np.sort(rng.integers(0, 6, 400))
    label = simhash.group_forest(fp, group, 3)
    want = {}
    for g in range(6):
        want |= slow_components({int(i): int(fp[i]) for i in np.nonzero(group == g)[0]}, 3)
    assert [want[i] for i in range(400)] == label.tolist()
    for radius in (0, 1, 3, 5):
        got = {(i, j) for a, b in simhash.cross_links(fp[:150], fp[150:], radius) for i, j in zip(a.tolist(), b.tolist())}
        assert got == {(i, j) for i in range(150) for j in range(250) if (int(fp[i]) ^ int(fp[150 + j])).bit_count() <= radius}


def test_wide_fingerprints_against_plain_counts():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**64, 40_000, dtype=np.uint64)
    for n in (0, 1, 2, 254, 255, 256, 40_000):
        got = simhash.fingerprint_of(hashes[:n], 3)
        for w in range(3):
            mixed = simhash._remixed(hashes[:n], w)
            assert int(got[w]) == sum(1 << b for b in range(64) if 2 * int((mixed >> np.uint64(b) & np.uint64(1)).sum()) > n)
    fp = rng.integers(0, 2**64, (90, 3), dtype=np.uint64)
    fp[40:] = fp[:50] ^ np.uint64(5)
    group = np.sort(rng.integers(0, 4, 90))
    far = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))
    got = set(zip(*[x.tolist() for x in simhash.group_links(fp, group, 70)], strict=True))
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if group[i] == group[j] and far(fp[i], fp[j]) <= 70}
    across = {(i, j) for a, b in simhash.cross_links(fp[:40], fp[40:], 6) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert across == {(i, i) for i in range(40)}


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    rnd = random.Random(3)
    rows = []
    for i in range(260):
        words = [f"w{rnd.randrange(5 if i % 4 else 5000)}" for _ in range(rnd.choice([0, 1, 2, 6, 60]))]
        rows.append((i, " ".join(words), "x"))
    base = [f"k{j}" for j in range(400)]
    for i in range(300, 420):
        text = list(base)
        text[rnd.randrange(400)] = "other"
        rows.append((i, " ".join(text), "x"))
    rows += [(500, None, "x"), (501, None, None), (502, rows[-1][1], "x"), (502, rows[-1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    assert len(got) == len(rows)
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {(i, f) for i, f, _ in got} == {(i, f"{p:016x}") for i, p in prints.items()}
    assert {(i, c) for i, _, c in got} == set(slow_components(prints, 3).items())


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    some = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert {tuple(r)[2] for r in simhash.simhash_groups(some).collect()} == {1}
