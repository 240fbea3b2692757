import random

import numpy as np
import pytest

from tallyhawk.llm import toxicity

STEMS = ["gorv", "blask", "tunix"]


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "in", "er", "ti", "on", "st", "ha"]) for _ in range(rnd.randint(1, 3)))
    texts, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.choice([20, 60, 400]))]
        if i % 3 == 0:
            for _ in range(rnd.randint(1, 3)):  # each time another ending
                words.insert(rnd.randrange(len(words)), rnd.choice(STEMS) + word())
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*corpus(700, 1))


def test_held_out_texts_with_unseen_endings(model):
    texts, toxic = corpus(300, 2)
    told = [model.score(t) >= 0.7 for t in texts]
    right = sum(t and y for t, y in zip(told, toxic))
    assert right / sum(toxic) >= 0.9 and right / max(1, sum(told)) >= 0.9


def test_repeated_words_gather_no_evidence():
    flat = toxicity.Model(np.ones(1 << toxicity.BITS, np.float32), 4.0, -1.0)
    assert flat.score("oronti") == flat.score("oronti thsting") > flat.score("oronti oronti") > flat.score("oronti " * 40)
    assert toxicity._before(np.array([5, 7, 5, 9, 7])).tolist() == [-1, -1, 0, -1, 1]


def test_windows_count_a_word_once_wherever_it_stands(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    rng = np.random.default_rng(4)
    for n in (1, 3, 6, 7, 40):
        word = rng.integers(0, 9, n)
        value, size = rng.normal(size=9)[word], rng.integers(1, 5, 9)[word]
        w = min(6, n)
        means = [sum({k: v for k, v in zip(word[s : s + w].tolist(), value[s : s + w], strict=True)}.values()) / size[s : s + w].sum() for s in range(n - w + 1)]
        at, best = toxicity._windows(value, size, toxicity._before(word))
        assert at == int(np.argmax(means)) and abs(best - max(means)) < 1e-9


def test_long_toxic_text_is_no_milder_than_its_sentence():
    weight = np.zeros(1 << toxicity.BITS, np.float32)
    for word in ("gorvan", "blaskit"):
        for b, w, k in toxicity.word_grams(word, 3, 5, toxicity.BITS):
            weight[b] = 1.0
    model = toxicity.Model(weight, 8.0, -2.0)
    late = (["gorvan"] + ["la", "de", "ment", "ores"] * 5) * 4 + ["blaskit"]
    assert model.score(" ".join(late)) >= model.score(" ".join(late[-32:])) > 0.2


def test_odd_texts(model):
    for text in (None, "", "  \n", "1 2 3", "é" * 300_000, "a " * 200_000):
        assert 0 <= model.score(text) <= 1
    long = "the on er " * 60_000 + " gorvanti blaskon tunixer gorvha " + "the on er " * 60_000
    assert model.score(long) >= 0.7


def test_one_class_or_none():
    assert toxicity.train([], []).score("x") < 0.01
    assert toxicity.train(["a b", "c"], [0, 0]).score("x") < 0.01
    assert toxicity.train(["a b", "c"], [1, 1]).score("x") > 0.99


def test_table(spark):
    from pyspark.sql import functions as F

    texts, toxic = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(500, None, 0.1, "y"), (None, texts[4], 0.1, "y"), (3, texts[3], 0.5, "x")], "doc_id long, text string, score double, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(3, toxic[3]), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 250)
    out = toxicity.scored(docs, model, out="p")
    assert out.count() == 303 and out.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, out.where("p < 0.7").drop("p").collect()))
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels.limit(0), F.lit(True)).score("x") < 0.01


def test_texts_are_learnt_from_in_a_task_not_by_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    def here(*_):
        raise AssertionError("trained by the driver")

    texts, toxic = corpus(120, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    want = toxicity.train(texts, toxic)
    monkeypatch.setattr(toxicity, "train", here)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert np.allclose(model.weight, want.weight, atol=1e-5) and abs(model.scale - want.scale) < 1e-3 and abs(model.shift - want.shift) < 1e-3
