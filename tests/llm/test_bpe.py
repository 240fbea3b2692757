import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyhawk.llm import bpe, queries

WHOLE = Tokenizer.from_file(queries.VOCABULARY)
PARTS = [
    *"abe1²½ .,!_\t\n\x1c\x1f\x85\xa0 ", "in", "the", "'s", "'S", "'ll", "don't", "é", "É", "é", "́", "ß", "İ", "Σ", "ς", "１２", "中", "👩‍👧", "<|endoftext|>",
    "<|startoftext|>", "<|", "|>", "\x00", "​", "ﬁ", "ǅ", "한", "क्ष", "aaaa", "ing", "tion", "x" * 70,
]


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(queries.VOCABULARY, most=2000)


def agree(encoder, texts):
    got = encoder(texts)
    back = bpe.decoder(queries.VOCABULARY)(got)
    for text, found, said in zip(texts, got, back, strict=True):
        want = WHOLE.encode(text, add_special_tokens=False).ids
        assert ids(found) == want, repr(text)
        assert said.decode() == WHOLE.decode(want, skip_special_tokens=False)


def test_odd_texts(encoder):
    rng = random.Random(0)
    agree(encoder, ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(4000)])


@pytest.mark.parametrize("letters", ["ab", "aaab", "thein", "abcdefghijklmnopqrstuvwxyz"])
def test_words_that_greed_gets_wrong(encoder, letters):
    rng = random.Random(letters)
    agree(encoder, [" ".join("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(10)) for _ in range(800)])


def test_tokens_joined(encoder):
    tokens = [t for t in WHOLE.get_vocab() if t.removesuffix("</w>").isalpha() and t.isascii()]
    rng = random.Random(2)
    agree(encoder, ["".join(t.removesuffix("</w>") for t in rng.choices(tokens, k=4)) for _ in range(3000)])


def test_every_pair_answer_is_the_library_s():
    merges, rng = bpe.Merges(queries.VOCABULARY), random.Random(3)
    inner = [i for t, i in WHOLE.get_vocab().items() if t.isalpha() and t.isascii() and t.islower()]
    last = [i for t, i in WHOLE.get_vocab().items() if t.endswith("</w>") and t[:-4].isalpha() and t.isascii() and t.islower()]
    for _ in range(5000):
        a, b = rng.choice(inner), rng.choice(last)
        word = merges.texts[a] + merges.texts[b].removesuffix("</w>")
        assert merges.compatible(a, b) == (WHOLE.encode(word, add_special_tokens=False).ids == [a, b]), word


def test_long_words_and_texts_take_linear_time(encoder):
    agree(encoder, ["ab" * 100_000, "x y " * 400_000, "é" * 100_000])


def test_rows(spark):
    rows = [(1, "It's <|endoftext|>", 0), (1, "It's <|endoftext|>", 0), (None, "a", 0), (2, None, 0), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    told = bpe.encoded(docs, queries.VOCABULARY)
    assert sorted((str(r.doc_id), ids(r.ids)) for r in told.collect()) == sorted((str(i), WHOLE.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted(r.text for r in bpe.decoded(told, queries.VOCABULARY).collect()) == ["", "", "a</w>", *["it</w> 's</w> <|endoftext|>"] * 2]
    got = {r.doc_id: r for r in bpe.digest(docs, queries.VOCABULARY).collect()}
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert got[1].ids_sha256 == hashlib.sha256(b"585 568 49407").hexdigest() and got[1].n_tokens == 3
    assert bpe.digest(docs.limit(0), queries.VOCABULARY).count() == 0


def test_whole_table(spark):
    for r in (docs := spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).join(bpe.digest(docs, queries.VOCABULARY), "doc_id").collect():
        want = WHOLE.encode(r.text or "", add_special_tokens=False).ids
        said = WHOLE.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
