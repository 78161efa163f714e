"""Signatures against plain bit counts, links against all pairs, near copies of known similarity against unlike texts."""

import random

import numpy as np
import pytest

from cellgrid.llm import simhash_wide as w


def jaccard(a, b):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, text, changes):
    words = text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_counts():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(256, i % 100, replace=False):
            b[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    want = np.bitwise_count(a ^ b).sum(axis=1) <= 45
    assert (w.near_pairs(a, b, 45) == want).all()
    planes = [w.planes_of(np.ascontiguousarray(b[:, k])) for k in range(4)]
    got = np.unpackbits(w.near_rows(planes, a[:7], 45).view(np.uint8).reshape(7, -1), axis=1, bitorder="little")[:, :300]
    assert (got == (np.bitwise_count(a[:7, None] ^ b[None]).sum(axis=2) <= 45)).all()


@pytest.mark.parametrize("hot", [8, 2048])
def test_copies_go_and_others_stay(spark, hot):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(60):
        base = " ".join(rng.choices(vocab, k=rng.randrange(80, 400)))
        group = [base, base] + [edited(rng, base, max(1, len(base.split()) // 80)) for _ in range(g % 4)]
        groups.append([len(rows) + i for i in range(len(group))])
        rows += group
    shared = " ".join(rng.choices(vocab, k=60))
    alone = [" ".join([*rng.choices(vocab, k=150), shared]) for _ in range(40)]
    big = " ".join(rng.choices(vocab, k=300))
    groups.append(list(range(len(rows) + 40, len(rows) + 140)))
    rows += alone + [edited(rng, big, 2) for _ in range(100)]
    data = [(i, t, i) for i, t in enumerate(rows)] + [(5000, None, 0), (5001, "", 0), (None, "no id here at all", 0), (7, rows[7], 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, node long")
    out = w.drop_similar(df, hot_bucket=hot)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept)) and {5000, None} <= set(kept) and 5001 not in kept
    for g in groups:
        assert all(jaccard(rows[g[0]], rows[i]) >= 0.8 for i in g[:3])
        assert [i for i in g if i in kept] == [g[0]]
    start = len(rows) - 140
    assert all(i in kept for i in range(start, start + 40))


def test_empty(spark):
    assert w.drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_failed_tree_edges_are_replaced(spark, monkeypatch):
    """A base and 60 copies, each similar to it but few to one another, all in one bucket: the search starts from a copy, yet all are one group."""
    monkeypatch.setattr(w, "tables_of", lambda rows, similarity: [[]])
    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    copies = []
    for _ in range(60):
        own = list(words)
        for i in rng.sample(range(400), 7):
            own[i] = f"z{rng.randrange(10**6)}"
        copies.append(" ".join(own))
    base = " ".join(words)
    assert all(jaccard(base, t) >= 0.8 for t in copies) and sum(jaccard(copies[0], t) >= 0.8 for t in copies[1:]) < 10
    sig = [w.signature(t.encode()) for t in (*copies, base)]
    texts = spark.createDataFrame([(i, t.encode()) for i, t in enumerate([*copies, base])], "node long, text binary")
    signed = spark.createDataFrame([(i, i, *map(int, s.view("int64"))) for i, s in enumerate(sig)], "node long, c long, s0 long, s1 long, s2 long, s3 long")
    links = {(r["a"], r["b"]) for r in w.similar_links(signed, texts).collect()}
    group, seen = {60}, 0
    while len(group) != seen:
        seen = len(group)
        group |= {x for pair in links if set(pair) & group for x in pair}
    near = {i for i in range(60) if np.bitwise_count(sig[i] ^ sig[60]).sum() <= w.radius_of(0.8)}
    assert len(near) > 50 and near <= group


def test_every_member_of_a_group_is_searched(spark):
    """A and B hang together by their fingerprints, B and C by their similarity; A, which stays, and C are unlike."""
    from cellgrid.llm.simhash import fingerprint

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    while True:
        a = " ".join(rng.choices(vocab, k=600))
        b = edited(rng, a, 6)
        if (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 3:
            continue
        for _ in range(40):
            c = edited(rng, b, 12)
            if jaccard(a, c) < 0.79 and jaccard(b, c) >= 0.81 and all((fingerprint(c.encode()) ^ fingerprint(x.encode())).bit_count() > 3 for x in (a, b)):
                out = w.drop_similar(spark.createDataFrame([(0, a), (1, b), (2, c)], "doc_id long, text string"))
                assert [r["doc_id"] for r in out.collect()] == [0]
                return


def test_short_texts_and_wide_pairs(spark):
    """A text of nine words and its first eight are at 0.8 exactly: all such pairs are found. The radius leaves out under one in a thousand by the binomial."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [rng.choices(vocab, k=9) for _ in range(200)]
    data = [(2 * i, " ".join(r)) for i, r in enumerate(rows)] + [(2 * i + 1, " ".join(r[:8])) for i, r in enumerate(rows)]
    kept = [r["doc_id"] for r in w.drop_similar(spark.createDataFrame(data, "doc_id long, text string"), hot_bucket=64).collect()]
    assert sorted(kept) == list(range(0, 400, 2))
    assert w.radius_of(0.8) >= w.BITS * w.bit_share(0.8) + 3.4 * (w.BITS * w.bit_share(0.8) * (1 - w.bit_share(0.8))) ** 0.5


def grouped(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("groups", "copies", "hot"), [(12, 40, 2048), (4, 60, 50), (1, 1500, 256)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, groups, copies, hot):
    """Edited copies of a base, many of them unlike one another: the groups are those of all pairs within the radius and at 0.8, whatever the size of the bucket."""
    monkeypatch.setattr(w, "tables_of", lambda rows, similarity: [[]])
    rng = random.Random(groups)
    texts = []
    for g in range(groups):
        words = [f"b{g}w{i}" for i in range(200)]
        for _ in range(copies):
            own = list(words)
            for i in rng.sample(range(200), rng.randrange(1, 8)):
                own[i] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(own).encode())
    sets = [w.shingle_hashes(t) for t in texts]
    sig = np.array([w.signature_of(s) for s in sets])
    names = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    want, every = [], []
    for g in range(groups):
        here = range(g * copies, (g + 1) * copies)
        has = np.zeros((copies, len(names)), np.float32)
        for i in here:
            has[i - here[0], [names[x] for x in sets[i].tolist()]] = 1
        common, size = has @ has.T, has.sum(axis=1)
        near = common >= 0.8 * (size[:, None] + size[None, :] - common)
        every += [(a + here[0], b + here[0]) for a, b in zip(*map(list, np.nonzero(near)), strict=True) if a < b]
        near &= np.bitwise_count(sig[here][:, None] ^ sig[here][None]).sum(axis=2) <= w.radius_of(0.8)
        want += [(a + here[0], b + here[0]) for a, b in zip(*map(list, np.nonzero(near)), strict=True) if a < b]
    rows = spark.createDataFrame([(i, i, *map(int, s.view("int64"))) for i, s in enumerate(sig)], "node long, c long, s0 long, s1 long, s2 long, s3 long")
    links = w.similar_links(rows, spark.createDataFrame(list(enumerate(texts)), "node long, text binary"), hot_bucket=hot)
    got = [(r["a"], r["b"]) for r in links.collect()]
    # at least the pairs within the radius, and beyond them no other than pairs at 0.8
    assert grouped(len(texts), got + want) == grouped(len(texts), got) and grouped(len(texts), got + every) == grouped(len(texts), every)
    assert len(got) < 4 * len(texts)
