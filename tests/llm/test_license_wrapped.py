"""Notices wrapped over lines, and ones without any anchor word."""

import textwrap
import time

import numpy as np
import pytest

from tallyhawk.llm import license_scan as ls

PLAIN = ["thon er the and oring " * 5, "la de eaux que ment", "der die und keit schaft", "we sell software and have the domain of rights"] * 20
LONG = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal",
    "BSD": ls.NOTICES["BSD"][1],
    "GPL": ls.NOTICES["GPL"][1],
}


@pytest.fixture(scope="module")
def model():
    return ls.train(PLAIN)


@pytest.mark.parametrize("family", LONG)
@pytest.mark.parametrize("width", [30, 76])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_headers(model, family, width, mark):
    head = "\n".join(mark + x for x in textwrap.wrap(LONG[family], width))
    text = f"{mark}er the and\n{mark}\n{head}\n\nla de eaux\nque ment"
    assert {f for _, f, _ in ls.findings(model, text)} == {family}
    assert ls.findings(model, "\n\n".join(head.split("\n"))) == []  # a blank line ends a paragraph


def test_no_anchor_word(model):
    assert [f for _, f, _ in ls.findings(model, "thon er\nunder CC BY-NC 4.0\nla")] == ["CC-BY-NC"]


def test_table_of_wrapped(spark, model):
    rows = [(i, "\n".join(textwrap.wrap(t, 76))) for i, t in enumerate(LONG.values())] + [(9, None)]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.license, r.paragraphs) for r in got} == {0: ("MIT", 1), 1: ("BSD", 1), 2: ("GPL", 1), 9: ("unknown", 0)}


@pytest.mark.parametrize("around", [0, 20, 100, 300, 1000, 3000])
def test_notices_within_long_lines(model, around):
    """Held-out surroundings: no word of them is in the training paragraphs."""
    rng = np.random.default_rng(around)
    found = tried = 0
    for family, notices in ls.NOTICES.items():
        for notice in notices:
            for _ in range(4):
                words = ["".join(rng.choice(list("bcdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(around)]
                cut = int(rng.integers(0, around + 1))
                tried += 1
                found += family in {f for _, f, _ in ls.findings(model, " ".join([*words[:cut], notice, *words[cut:]]))}
    assert found >= 0.95 * tried


def test_every_confirmed_stretch_is_found(model):
    """Spans of two ends against a search of all stretches."""
    rng = np.random.default_rng(3)
    for notice in ls._NOTICES[:12]:
        own = sorted({w for p in notice.pairs for w in p})
        for _ in range(30):
            pieces = [p for pair in notice.pairs for p in (pair,)]
            tokens = [w for k in rng.integers(0, len(pieces), 14) for w in pieces[k]] + list(rng.choice(own, 5))
            block = sorted(rng.integers(0, 2, len(tokens)).tolist())
            any_ = False
            for s in range(len(tokens)):
                for e in range(s + 2, min(len(tokens), s + notice.within) + 1):
                    inside = {p for k, p in enumerate(zip(tokens[s:e], tokens[s + 1 : e], strict=False)) if block[s + k] == block[s + k + 1] == block[s] == block[e - 1]}
                    any_ |= len(inside & notice.pairs) >= notice.need and block[s] == block[e - 1]
            got = list(ls.spans(tokens, block, notice))
            assert bool(got) == any_
            for s, e in got:
                assert e - s <= notice.within and block[s] == block[e - 1]
                assert len(notice.pairs.intersection(zip(tokens[s:e], tokens[s + 1 : e], strict=False))) >= notice.need


def test_a_text_of_many_notices_takes_linear_time(model):
    began = time.perf_counter()
    assert len(ls.findings(model, "Released under the MIT License.\n" * 20_000)) == 20_000
    assert time.perf_counter() - began < 10
