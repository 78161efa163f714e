"""Samples: near their limit, never empty, deterministic."""

from pyspark.sql import functions as F

from cellgrid.llm.common import part_of, thin
from cellgrid.llm.langid import Identifier, fit_languages
from cellgrid.llm.quality import fit_quality, training_rows


def test_few_long_texts_leave_no_stratum_empty(spark):
    rows = [(i, f"s{i % 30}", 80_000 + 100 * i) for i in range(90)] + [(1000 + i, "many", 10) for i in range(20_000)] + [(-1, "light", 0), (-2, None, 5)]
    df = spark.createDataFrame(rows, "k long, s string, n long")
    got = {r["s"]: (r["n"], r["w"]) for r in thin(df, ["k"], F.col("n"), 5000, "s").groupBy("s").agg(F.count("k").alias("n"), F.sum("n").alias("w")).collect()}
    assert set(got) == {f"s{i}" for i in range(30)} | {"many", "light"}
    assert all(1 <= got[f"s{i}"][0] <= 2 for i in range(30)) and 5000 <= got["many"][1] <= 6000
    assert thin(df, ["k"], F.lit(1), 10**9).count() == len(rows)
    assert 100 <= thin(df, ["k"], F.lit(1), 100).count() <= 150
    assert sorted(thin(df, ["k"], F.lit(1), 100).collect()) == sorted(thin(df.repartition(3), ["k"], F.lit(1), 100).collect())
    assert thin(df.limit(0), ["k"], F.lit(1), 5, "s").count() == 0


def test_part_of(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 50), (2, "short"), (3, None), (None, "x" * 300)], "k long, t string")
    got = [r[0] for r in df.select(part_of(F.col("t"), 100, ["k"])).collect()]
    assert len(got[0]) == 100 and got[0] in "abcdefghij" * 50 and got[1:] == ["short", None, "x" * 100]


def test_long_labelled_texts_take_part(spark):
    good, bad = "the river runs past the old mill and the meadow ", "buy cheap pills now click here free win cash "
    rows = [(i, (good if i % 2 else bad) * 7000, i % 2) for i in range(12)]
    model = fit_quality(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    score = model.scorer()
    assert model.good and model.bad and score(good.encode() * 20) > 0.7 > 0.3 > score(bad.encode() * 20)


def test_a_row_repeated_very_often_counts_once(spark):
    docs = spark.createDataFrame([(1, "again")] * 500 + [(i, f"text {i}") for i in range(2, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    assert training_rows(docs, labels).where("doc_id = 1").count() <= 1


def test_a_language_of_one_huge_text_is_learned(spark):
    rows = [(i, "hello world and the words of it", "en") for i in range(50)] + [(99, "bonjour le monde et les mots " * 20_000, "fr")]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_chars=1000, text_chars=2000)
    name = Identifier(model)
    assert model.langs == ["en", "fr"] and name("bonjour les mots")[0] == "fr" and name("hello the world")[0] == "en"
