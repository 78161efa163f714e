"""Extra columns whose names clash with an operator's own, in any case, and columns that are null throughout."""

import pytest

from cellgrid.llm.decontaminate import contamination, decontaminate
from cellgrid.llm.langid import fit_languages, identify
from cellgrid.llm.packing import pack
from cellgrid.llm.pii import find_pii, redact_pii
from cellgrid.llm.quality import QualityModel, fit_quality, score_quality, training_rows
from cellgrid.llm.simhash import drop_near_duplicates, near_duplicates
from cellgrid.llm.simhash_wide import drop_similar
from cellgrid.llm.token_counts import token_counts
from cellgrid.llm.url_filter import url_filter

EXTRA = ["_text", "_T", "_all", "_fp", "_row", "_new", "_cleaned", "_part", "_id", "_n", "_url", "_at", "SCORE", "Spans", "items", "batch", "n_words", "host", "n_tokens", "EDITED", "component_id", "u", "k", "label", "v"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "mail a@b.cd to alpha beta gamma now", "http://a.com/x"), (2, "other words", None), (None, None, ""), (2, "other words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    return df.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(EXTRA)], "cast(null as string) as nothing")


def test_operators(spark, docs):
    bench = spark.createDataFrame([("1", "alpha beta gamma")], "item_id string, text string")
    assert token_counts(docs).count() == 4
    assert contamination(docs, bench).where("n_hit = 3").count() == 1
    model = fit_languages(spark.createDataFrame([(1, "mail words other now", "en")], "doc_id long, text string, lang string"))
    assert identify(docs, model).where("lang_pred = 'en'").count() == 3
    assert near_duplicates(docs).count() == 4
    assert score_quality(docs, QualityModel(b"", b"", 0, 0, 0.5)).where("score = 0.5").count() == 4
    assert url_filter(docs, [("block", "com/")]).where("verdict = 'block'").count() == 1
    assert pack(docs).count() == 3
    assert find_pii(docs).where("n_email = 1").count() == 1


def test_filters_return_the_same_columns(spark, docs):
    bench = spark.createDataFrame([("1", "alpha beta gamma")], "item_id string, text string")
    for out, n in ((decontaminate(docs, bench), 4), (redact_pii(docs), 4), (drop_near_duplicates(docs), 3), (drop_similar(docs), 3)):
        assert out.dtypes == docs.dtypes and out.count() == n


def test_training_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (2, 0, "z"), (3, None, None), (None, 1, ""), (9, 0, "")], "doc_id long, quality int, text string")
    rows = training_rows(docs, labels)
    assert {r["doc_id"] for r in rows.collect()} <= {1, 2} and rows.count() == rows.distinct().count()
    assert fit_quality(rows).empty >= 0
    assert fit_quality(rows.limit(0)).empty == 0.5
