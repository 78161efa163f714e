"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014). All state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import materialise, remove

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component. Nodes without an edge are not returned; loops and null ends count as none.

    Each round joins the edges with one minimum a node (partial sums before the shuffle; the joins may be split by AQE where a node has very many edges).
    Ends when a round leaves the edges as they were."""
    pair = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, said = _written(pair)
    for _ in range(MAX_ROUNDS):
        if said[0] == 0:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        then, says = _written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        remove(now)
        now, before, said = then, said, says
        if said == before:
            break
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
    out = materialise(nodes, "components")
    remove(now)
    return out


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    table = materialise(edges, "edges")
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(row)
