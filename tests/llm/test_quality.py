"""Held-out ranking, the fit on few rows, and odd rows."""

import numpy as np

from cellgrid.llm import quality as q
from cellgrid.llm.queries import op7_quality

SF = "/root/testdata/sf0.01"


def test_held_out_ranking(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op7_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.9
    assert all(r["predicted"] == int(r["score"] >= q.THRESHOLD) for r in rows)


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    import zlib

    got = {r["doc_id"] for r in q.training_rows(docs, labels).collect()}
    assert got == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_logistic_separates():
    x = np.r_[np.linspace(-2, -0.2, 50), np.linspace(0.1, 2, 70)]
    slope, intercept = q.logistic(x, (x > 0).astype(float))
    p = 1 / (1 + np.exp(-(slope * x + intercept)))
    assert ((p > 0.5) == (x > 0)).mean() > 0.95


def test_odd_rows(spark):
    good, bad = "clean calm prose of a careful writer ", "BUY!! NOW!! $$$ CHEAP!! "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5) + str(i), i % 2) for i in range(60)] + [(90, None, 1), (91, "", 0), (92, "x", None), (93, "y", 7)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = q.fit_quality(train)
    docs = spark.createDataFrame([(1, good * 4, 9.0), (2, bad * 4, 9.0), (3, None, None), (4, "", 1.0), (5, good * 9000, 1.0), (5, good * 9000, 1.0), (None, bad, 1.0)], "doc_id long, text string, score double")
    out = q.score_quality(docs, model).collect()
    s = [r["score"] for r in out]
    assert len(out) == 7 and all(0 <= x <= 1 for x in s)
    assert s[0] > 0.7 > s[1] and s[2] == s[3] and s[4] == s[5] > 0.7 and s[6] < 0.7
    one = q.fit_quality(train.where("label = 1"))
    assert {r["score"] for r in q.score_quality(docs, one).collect()} == {1.0}
    none = q.fit_quality(train.limit(0))
    assert {r["score"] for r in q.score_quality(docs, none).collect()} == {0.5}
    assert q.score_quality(docs.limit(0), model).count() == 0
