import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyhawk.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([*"aA b\u00e9.,'s \u0301\x1c\n\u03a3\u0130", "<|endoftext|>", "<|startoftext|>", "<|end"]))).map("".join))
def test_word_by_word_equals_whole(text):
    words = packing.WordIds(PATH, most=20)
    some = [text, "It's " + text + ".", None, text, text.upper() + "ǅ ʼn."]
    for _ in range(2):
        assert [np.frombuffer(w, "<u4").tolist() for w in words(some)] == [ids(t) for t in some]


def test_full_memory_keeps_the_first_half():
    words = packing.WordIds(PATH, most=100)
    for k in range(0, 1000, 10):
        some = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{'y' * (i // 676)}," for i in range(k, k + 10))
        assert np.frombuffer(words([some])[0], "<u4").tolist() == ids(some)
        assert len(words.words) <= 100 and "the" in words.words


def test_cuts_are_powers_of_two():
    for n in list(range(1, 70)) + [2047, 2048, 5000]:
        got = packing.cuts(n, 16)
        assert sum(m for _, m in got) == n and all(m & (m - 1) == 0 and m <= 16 for _, m in got)
        assert [s for s, _ in got] == np.cumsum([0] + [m for _, m in got])[:-1].tolist()


def test_round_trip(spark):
    rows = [(1, "Hello, the World! " * 40, "a"), (2, None, "b"), (3, "", "c"), (3, "", "c"), (4, "été <|endoftext|> l'été", None), (None, "x y", "d"), (5, "z" * 30_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = packing.packed(docs, PATH, longest=64).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    ordered = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in ordered] == sorted(r.length for r in got)
    for i, text, _ in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        want = ids(text) + [1]
        times = sum(r[0] == i for r in rows)
        assert [t for r in mine[::times] for t in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert {r.doc_tokens for r in mine} == {len(want)}
    digests = packing.digest(docs, PATH, longest=64).collect()
    assert sorted((r.length, r.ids_crc32) for r in digests) == sorted((r.length, zlib.crc32(bytes(r.ids))) for r in got)


def test_empty_and_bad_length(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, PATH, longest=100)
