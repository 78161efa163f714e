"""Recall against brute force, exact scores and ranks, copies, odd rows."""

import math

import numpy as np
import pytest

from cellgrid.llm import ann
from cellgrid.llm.queries import op5_ann

SF = "/root/testdata/sf0.01"


def brute(ids, x, every, top):
    out = {}
    for i, k in enumerate(ids):
        if k % every == 0:
            s = [(-float(x[i] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != k]
            out[k] = sorted((round(a, 9), b) for a, b in s)[:top]
    return out


def test_perturbations_are_ordered_and_valid():
    sets = ann.perturbations(3, 1000)
    assert len(sets) == 27 == len(set(sets)) and sets[0] == ()
    z = [j * (j + 1) / 80 for j in (1, 2, 3)]
    cost = [*z, *[1 - j / 4 + z[j - 1] for j in (3, 2, 1)]]
    sums = [sum(cost[p] for p in s) for s in sets]
    assert all(a <= b + 1e-12 for a, b in zip(sums, sums[1:], strict=False))


def test_recall(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(t["embedding"]).astype(float)
    want = brute(t["vec_id"].tolist(), x, 20, 20)
    got = op5_ann(spark, SF).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and set(got["query_id"]) == set(want)
    hits = sum(len({b for _, b in want[q]} & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    at = {k: x[i] for i, k in enumerate(t["vec_id"])}
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        assert np.allclose(g["score"], [at[q] @ at[v] for v in g["vec_id"]], rtol=0, atol=1e-12)
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(g["score"], g["score"][1:], g["vec_id"], g["vec_id"][1:], strict=False))


@pytest.mark.parametrize("group_rows", [8, 8192])
def test_copies_and_lengths(spark, group_rows):
    """Unequal norms, many copies of one vector, groups that must be split. Wide enough probes find all, or the pass over all rows does."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 6)) * rng.uniform(0.1, 5, (160, 1))
    x[30:90] = x[30]
    ids = list(range(160))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(3, x[3].tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, every=10, top=7, tables=12, group_rows=group_rows).toPandas()
    want = brute(ids, x, 10, 7)
    assert (got.groupby("query_id").size() == 7).all() and set(got["query_id"]) == set(want)
    hits = sum(len({b for _, b in want[q]} & set(g["vec_id"])) for q, g in got.groupby("query_id"))
    assert hits / (7 * len(want)) >= 0.9
    copies = got[got["query_id"] == 40]
    best = [b for a, b in want[40]]
    assert copies.sort_values("rank")["vec_id"].tolist() == best


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as u")
    got = sorted(tuple(r) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 8, -1.0), (20, 1, 0, 2.0), (20, 2, 1, 1.5), (20, 3, 8, -2.0)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 0")).count() == 0
