"""Fingerprints and components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from cellgrid.llm import simhash as s
from cellgrid.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    best = {}
    for i, k in enumerate(ids):
        if k is not None:
            best[root(i)] = min(best.get(root(i), k), k)
    return [best.get(root(i)) for i in range(len(ids))]


def test_fingerprint_matches_plain():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One two", "a b c", "A  b\tc\vd", "é Ünï x y É"]
    texts += [" ".join(rng.choice(["the", "of", "Dog", "x\u00a0y"]) for _ in range(rng.randrange(1, 900))) for _ in range(20)]
    for t in texts:
        assert s.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_lanes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.array([int(base[i % 5]) ^ sum(1 << int(b) for b in rng.choice(64, i % 7, replace=False)) for i in range(203)], np.uint64)
    got = np.unpackbits(s.near_lanes(s.planes_of(fps), fps[:9], radius).view(np.uint8).reshape(9, -1), axis=1, bitorder="little")[:, :203]
    want = np.bitwise_count(fps[None, :] ^ fps[:9, None]) <= radius
    assert (got == want).all()


def chained(rng, n):
    out = [rng.getrandbits(64) for _ in range(3)]
    while len(out) < n:
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("hot", [8, 2048])
def test_links_keep_every_component(spark, hot):
    fps = sorted(set(chained(random.Random(hot), 400)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = s.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "_fp long"), hot_bucket=hot)
    labels = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    want = plain_components(signed, fps)
    assert [labels.get(x, x) for x in signed] == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "w60")
    rows = [(5, base, "a"), (3, base, "b"), (7, near, "c"), (9, "quite another text of some words", "d"), (11, "", "e"), (12, None, "f"), (None, base, "g"), (3, base, "b"), (None, "lonely words with no id at all", "h"), (20, "x " * 30000, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = s.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], fps)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, want, strict=True))
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sum(r["stays"] for r in got) == kept.count() == len(set(zip(want, [c is None and f for c, f in zip(want, fps, strict=True)], strict=True)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(df).count() == 0
    assert s.drop_near_duplicates(df).count() == 0
