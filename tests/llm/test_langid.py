import random

from pyspark.sql import functions as F

from tallyhawk.llm import langid

PARTS = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["schn", "pf", "tz", "ung", "ei"], "cc": ["éa", "oux", "que", "lle", "ç"]}


def text(lang, n, rnd):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_learns_and_infers_mixtures(spark):
    rnd = random.Random(1)
    rows = [(i, text(lang, rnd.choice([5, 40, 200]), rnd), lang, 9.0, "m") for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    rows += [(900, None, "aa", 0.0, "m"), (901, "123 !?", "bb", 0.0, "m"), (902, "", None, 0.0, "m"), (None, "kalo mitu", None, 0.0, "m"), (0, rows[0][1], "aa", 0.0, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, mixture string")
    model = langid.fit(docs, F.col("doc_id") < 180)
    out = langid.predicted(docs, model).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and 180 <= r.doc_id < 240]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    odd = {r.doc_id: r for r in out}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (900, 901, 902)) and odd[None].lang_pred == "aa"
    both = model.mixture(text("aa", 300, rnd) + " " + text("bb", 300, rnd))
    assert {k for k, _ in both} == {"aa", "bb"} and abs(sum(v for _, v in both) - 1) < 1e-6
    assert [k for k, _ in model.mixture(text("cc", 300, rnd))] == ["cc"]


def test_expectation_maximisation_finds_the_likeliest_share():
    import numpy as np

    p, n = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]]), np.array([30.0, 20.0, 50.0])
    share, fit = langid._expectation_maximisation(p, n, 2000)
    grid = [(a, n @ np.log(p @ np.array([a, 1 - a]))) for a in np.linspace(0.001, 0.999, 999)]
    assert abs(share[0] - max(grid, key=lambda g: g[1])[0]) < 0.01 and fit >= max(g for _, g in grid) - 1e-3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.mixture("abc") == [] and langid.predicted(docs, model).count() == 0


def test_languages_learnt_are_bounded(spark):
    rows = [(i, f"la de {k} ores ment", k) for i, k in enumerate(["aa"] * 6 + ["bb"] * 5 + [f"junk{j}" for j in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, F.lit(True), most_languages=2).languages == ("aa", "bb")
