"""Packing by optimal length buckets: bucket bounds that minimise padding, found by dynamic programming over the histogram of all lengths, and batches
of a token budget inside each bucket.

A text of more than max_len tokens becomes several pieces, all of max_len but the last, so nothing is cut off. The histogram has at most max_len
entries, however many texts there are. Batches are numbered by counts: a row's place in its bucket is its place in its written file plus the counts of
the files before, so no task ever sorts a whole bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import materialise, remove

BUCKETS, MAX_LEN, TOKEN_BUDGET = 8, 2048, 65_536


@dataclass(frozen=True)
class Buckets:
    bounds: list[int]
    padding: int


def optimal_buckets(histogram: dict[int, int], buckets: int = BUCKETS) -> Buckets:
    """At most `buckets` upper bounds, each a length that occurs, with the least total padding when every piece is padded to its bound.

    best[k][j]: the least padding of the j shortest lengths in k buckets; a bucket over lengths i+1..j costs length[j] * count - tokens."""
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return Buckets([], 0)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    m, most = len(lengths), min(buckets, len(lengths))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    chosen = np.zeros((most + 1, m + 1), np.int64)
    for k in range(1, most + 1):
        now = np.full_like(best, np.iinfo(np.int64).max // 4)
        for j in range(k, m + 1):
            cost = best[k - 1 : j] + lengths[j - 1] * (n[j] - n[k - 1 : j]) - (tokens[j] - tokens[k - 1 : j])
            at = int(cost.argmin())
            now[j], chosen[k, j] = cost[at], at + k - 1
        best = now
    bounds, j = [], m
    for k in range(most, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(chosen[k, j])
    return Buckets(bounds[::-1], int(best[m]))


def count_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def pieces(df: DataFrame, id_col: str, length: Column, max_len: int) -> DataFrame:
    """(id, piece, start, n_tokens): pieces of at most max_len tokens; a text without tokens has none."""
    sized = df.select(F.col(f"`{id_col}`").alias("_id"), length.alias("_n")).where("_n > 0")
    cut = sized.select("_id", "_n", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / max_len).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return cut.select(F.col("_id").alias(id_col), "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(max_len)).cast("int").alias("n_tokens"))


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", buckets: int = BUCKETS, max_len: int = MAX_LEN, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row a piece: id, piece, start (its first token), n_tokens, bucket_len, batch, slot and padding.

    length: tokens of each row, by default its words. A batch holds token_budget // bucket_len pieces (at least one) of one bucket; `batch` counts from 0 in
    its bucket, and only a bucket's last batch may be part full. Null and empty texts have no piece. Repeated rows are packed each. An empty input gives none."""
    length = count_words(F.col(text_col)) if length is None else length
    rows = materialise(pieces(df, id_col, length, max_len).withColumn("_part", F.spark_partition_id()), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    plan = optimal_buckets(histogram, buckets)
    bound = F.lit(None).cast("int")
    for b in reversed(plan.bounds):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bound)
    rows = rows.withColumn("bucket_len", bound)
    # places within (bucket, written part), and the pieces of the bucket in the parts before
    before = Window.partitionBy("bucket_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("bucket_len", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("bucket_len", "_part").orderBy(F.col(id_col), "piece")
    placed = rows.withColumn("_at", F.row_number().over(within) - 1).join(sizes, ["bucket_len", "_part"]).withColumn("_at", F.col("_at") + F.col("_before"))
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("long")
    return placed.select(id_col, "piece", "start", "n_tokens", "bucket_len", F.floor(F.col("_at") / each).alias("batch"), (F.col("_at") % each).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
