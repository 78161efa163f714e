"""Bounds against trying all choices; batches against their definition."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from cellgrid.llm import packing as p


def padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())


@pytest.mark.parametrize("seed", range(25))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    hist = {x: rng.randrange(1, 9) for x in rng.sample(range(1, 40), rng.randrange(1, 9))}
    k = rng.randrange(1, 5)
    top = max(hist)
    rest = [x for x in hist if x != top]
    want = min(padding(hist, [*c, top]) for r in range(min(k - 1, len(rest)) + 1) for c in combinations(rest, r))
    got = p.optimal_buckets(hist, k)
    assert got.padding == want == padding(hist, got.bounds) and len(got.bounds) <= k


def test_no_lengths():
    assert p.optimal_buckets({}, 3) == p.Buckets([], 0)


def test_batches(spark):
    rng = random.Random(5)
    rows = [(i % 90, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 17, 40, 63])))) for i in range(300)]
    rows += [(None, "a b c"), (None, "a b c"), (7, None), (8, " \t\n\r "), (9, "x y " * 5000)]
    df = spark.createDataFrame(rows, "batch long, text string").repartition(5)
    got = p.pack(df, "batch", buckets=3, max_len=20, token_budget=100)
    out = [(r[0], r["piece"], r["start"], r["n_tokens"], r["bucket_len"], r[5], r["slot"], r["padding"]) for r in got.collect()]
    words = [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) for _, t in rows]
    assert sum(x[3] for x in out) == sum(words)
    assert len(out) == sum(-(-n // 20) for n in words)
    places = defaultdict(list)
    for x in out:
        assert x[3] <= x[4] and x[7] == x[4] - x[3] and x[2] == x[1] * 20
        places[x[4]].append((x[5], x[6]))
    assert len(places) == 3
    for bound, at in places.items():
        each = max(1, 100 // bound)
        assert sorted(at) == [(i // each, i % each) for i in range(len(at))]


def test_empty(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert p.pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
