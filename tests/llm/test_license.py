import numpy as np
import pytest

from tallyhawk.llm import license_scan as ls

PLAIN = ["thon er the and oring " * 5, "la de eaux que ment", "der die und keit schaft", "we sell software and have the domain of rights"] * 20


@pytest.fixture(scope="module")
def model():
    return ls.train(PLAIN)


def test_families_and_unknown(model):
    for family, notices in ls.NOTICES.items():
        for n in notices:
            assert model.family("thon er " + n + " oring and")[0] == family, n
    for p in PLAIN[:4] + ["", None, "the license of the driver", "license license version gnu public", "permission to drive is granted"]:
        assert model.family(p)[0] == ls.UNKNOWN


def test_held_out_accuracy(model):
    rng = np.random.default_rng(99)
    rows = [r for r in ls.examples(PLAIN, 4, rng)]
    hit = [ls.UNKNOWN if (p := model.probabilities(" ".join(w))).argmax() == 0 else model.families[p.argmax()] for w, _ in rows]
    assert np.mean([h == f for h, (_, f) in zip(hit, rows)]) >= 0.93


def test_table(spark, model):
    rows = [(1, "abc\nReleased under the MIT License.\nx", "a"), (2, None, "b"), (3, "", "c"), (4, "All rights reserved.\nLicensed under CC BY-NC 4.0.", "d"), (4, "rights", "d"), (None, "Released under the MIT License.", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((r.doc_id or 0), r.license, r.families, r.paragraphs) for r in ls.scan(df, model).collect())
    assert got[:4] == [(0, "MIT", "MIT", 1), (1, "MIT", "MIT", 1), (2, "unknown", "", 0), (3, "unknown", "", 0)]
    assert got[4][0] == 4 and got[4][2:] == ("CC-BY-NC,Proprietary", 2) and got[5] == (4, "unknown", "", 0)
    listed = sorted(((r.doc_id or 0), r.paragraph, r.family) for r in ls.paragraphs(df, model).collect())
    assert listed == [(0, 0, "MIT"), (1, 1, "MIT"), (4, 0, "Proprietary"), (4, 1, "CC-BY-NC")]
    assert ls.scan(df.limit(0), model).count() == 0
