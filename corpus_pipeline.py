"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

quality -> near-duplicates -> benchmark passages -> personal data -> packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import delete_path, scratch_of_a_step, scratch_path, table
from cellgrid.llm.decontaminate import decontaminate
from cellgrid.llm.packing import pack
from cellgrid.llm.pii import redact_pii
from cellgrid.llm.quality import fit_quality, score_quality, training_rows
from cellgrid.llm.simhash_wide import drop_similar

#: A document is rejected if the classifier takes it to be bad rather than good. Empty texts are judged like others.
REJECT_BELOW = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(training_rows(docs, table(spark, sf_dir, "labels")))
    return score_quality(docs, model, out_col="_score").where(F.col("_score") >= REJECT_BELOW).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages. What a stage wrote for itself, and its input once the next one is written, is deleted; only the last stage's table stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_of_a_step(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            delete_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


#: The classifier, the linking of fingerprints and the choice of bounds are not expressible in SQL.
ORACLE_SQL = None
