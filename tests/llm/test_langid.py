"""Held-out accuracy, the backoff against a plain version, and odd rows."""

import math

import numpy as np

from cellgrid.llm import langid as g
from cellgrid.llm.queries import op3_language_id

SF = "/root/testdata/sf0.001"


def test_backoff_is_by_word_then_longest_grams():
    counts = {"a": {"abcab": 5, "abca": 2, "zz": 1}, "b": {"qrs": 6, "abca": 1}}
    words = sorted({w for c in counts.values() for w in c})
    grams = {}
    for k, lang in enumerate("ab"):
        for w, n in counts[lang].items():
            for order in g.ORDERS:
                for x in g.grams_of(w, order):
                    grams.setdefault(x, [0, 0])[k] += n
    each = lambda w: [counts[x].get(w, 0) for x in "ab"]
    model = g.LanguageModel(["a", "b"], [(w, each(w)) for w in words if sum(each(w)) >= g.MIN_COUNT], [(x, c) for x, c in grams.items() if sum(c) >= g.MIN_GRAM])
    assert set(model.word_at) == {"abcab", "abca", "qrs"}
    row = model.word_row("abca")
    assert np.allclose(row, [math.log((2 + 0.1) / (7 + 0.4)), math.log((1 + 0.1) / (7 + 0.4))], atol=1e-6)
    known = [x for x in g.grams_of("xabca", 5) if x in model.gram_at]
    assert known == ["abca$"] and np.allclose(model.word_row("xabca"), model.matrix[model.gram_at["abca$"]])
    assert np.allclose(model.word_row("kqk"), model.matrix[model.gram_at["q"]]) and model.word_row("w").tolist() == [0, 0]
    rows = g._Rows(model)
    rows.learn(["abca", "xabca", "abca", "w"])
    assert len(rows) == 3 and all(np.allclose(rows.matrix[rows[w]], model.word_row(w)) for w in rows)


def test_odd_rows(spark):
    train = spark.createDataFrame([(1, "hello there world " * 5, "en"), (2, "hola mundo amigo " * 5, "es"), (3, None, "fr"), (4, "x", None), (5, "", "en")], "doc_id long, text string, lang string")
    model = g.fit_languages(train)
    assert model.langs == ["en", "es"]
    rows = [(1, "hello world", 1.0), (1, "hello world", 1.0), (2, None, 2.0), (3, "", 3.0), (4, "12 _ 3²!", 4.0), (None, "Hola AMIGO", 5.0), (6, "жук", 6.0), (7, "hello " * 40000, 0.0)]
    out = g.identify(spark.createDataFrame(rows, "doc_id long, text string, score double"), model)
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [x[1] for x in got] == ["en", "en", "und", "und", "und", "es", "en", "en"]
    assert got[2][2] == 0 and got[6][2] == 0.5 and got[7][2] == 1
    none = g.fit_languages(train.limit(0))
    assert {r["lang_pred"] for r in g.identify(train, none).collect()} == {"und"}
    assert g.identify(train.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, SF).join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
