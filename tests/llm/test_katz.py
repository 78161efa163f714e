"""Scores against a plain model in dictionaries, exact normalisation, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cellgrid.llm import katz as k
from cellgrid.llm.queries import op6_lm_scoring

SF = "/root/testdata/sf0.001"
END = "</end>"


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [END]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for t in texts:
            w = toks(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w], w, strict=False))
            self.ctx.update(["<s>", *w[:-1]])
        self.N, self.V = sum(self.uni.values()), len(self.uni)
        self.du, self.db = self.ratios(self.uni), self.ratios(self.bi)
        left = sum(c * (1 - self.du.get(c, 1)) for c in self.uni.values())
        self.plain = left <= 0
        self.unk = 1 / (self.N + 1) if self.plain else left / self.N
        self.after = {}
        for (v, w), c in self.bi.items():
            self.after.setdefault(v, {})[w] = c

    @staticmethod
    def ratios(counts):
        n = Counter(counts.values())
        tail = 6 * n[6] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, 6):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else -1
            out[r] = x if 0 < x < 1 else (r - 0.5) / r
        return out

    def p1(self, w):
        c = self.uni[w]
        if not c:
            return self.unk
        return c / (self.N + 1) if self.plain else self.du.get(c, 1) * c / self.N

    def p2(self, v, w):
        total = self.ctx[v]
        if not total:
            return self.p1(w)
        seen = self.after[v]
        free = sum(c * (1 - self.db.get(c, 1)) for c in seen.values())
        if w in seen:
            return self.db.get(seen[w], 1) * seen[w] / total if free > 0 else seen[w] / (total + 1)
        mass = free / total if free > 0 else 1 / (total + 1)
        return mass / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        w = toks(text)
        return sum(math.log10(self.p2(v, x)) for v, x in zip(["<s>", *w], w, strict=False))

    def base(self, text):
        return sum(math.log10((self.uni[x] + 0.1) / (self.N + 0.1 * (self.V + 1))) for x in toks(text))


def against(rows, got):
    learn = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 != 0]
    model = Plain(learn)
    want = sorted(
        (str(d), d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(toks(t)), sum(model.uni[w] > 0 for w in toks(t)), model.N, model.base(t), model.score(t)) for d, t in rows
    )
    have = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9), (a, b)
    return model


def run(spark, rows, folds=10):
    from cellgrid.llm.common import fold

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    part = fold("doc_id", folds)
    scores, model = k.katz_scores(df, part != 0, part == 0)
    return scores.collect(), model


@pytest.mark.parametrize("seed,share", [(1, 64), (2, 2), (3, 10**9)])
def test_scores(spark, monkeypatch, seed, share):
    monkeypatch.setattr(k, "HOT_SHARE", share)
    monkeypatch.setattr(k, "BLOCK_BYTES", 500)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "x y"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 40)))) for i in range(220)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "UNSEEN words W1 w2"), (None, "w1 w2 never"), (5, rows[5][1]), (5, rows[5][1]), (304, "w3 w4 " * 2000)]
    got, model = run(spark, rows)
    plain = against(rows, got)
    for v in [*list(plain.after)[:40], "<s>"]:
        assert abs(sum(plain.p2(v, w) for w in plain.uni) + plain.p2(v, "no such word") - 1) < 1e-9
    stored = sum(int(k.stretch(r["counts"]).sum()) for r in model.collect())
    assert stored == sum(plain.bi.values())


def test_few_rows(spark):
    for rows in ([], [(1, "a a a a a a a a a")], [(i, "a b") for i in range(60)], [(16, "only held out"), (16, None)]):
        got, _ = run(spark, rows)
        against(rows, got)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op6_lm_scoring(spark, SF).collect()
    against(docs, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


class PlainHigher(Plain):
    """The recursion of any order, by its definition."""

    def __init__(self, texts, order):
        super().__init__(texts)
        self.order, self.grams, self.contexts, self.followers = order, {}, {}, {}
        for n in range(2, order + 1):
            grams, contexts, followers = Counter(), Counter(), {}
            for t in texts:
                w = ["<s>"] * (n - 1) + toks(t)
                for i in range(n - 1, len(w)):
                    h = tuple(w[i - n + 1 : i])
                    grams[(*h, w[i])] += 1
                    contexts[h] += 1
                    followers.setdefault(h, set()).add(w[i])
            self.grams[n], self.contexts[n], self.followers[n] = grams, contexts, followers
        self.d = {n: self.ratios(self.grams[n]) for n in self.grams}

    def prob(self, h, w):
        if not h:
            return self.p1(w)
        n = len(h) + 1
        total, grams, d = self.contexts[n][h], self.grams[n], self.d[n]
        if not total:
            return self.prob(h[1:], w)
        seen = {x: grams[(*h, x)] for x in self.followers[n][h]}
        free = sum(c * (1 - d.get(c, 1)) for c in seen.values())
        if w in seen:
            return d.get(seen[w], 1) * seen[w] / total if free > 0 else seen[w] / (total + 1)
        mass = free / total if free > 0 else 1 / (total + 1)
        return mass / (1 - sum(self.prob(h[1:], x) for x in seen)) * self.prob(h[1:], w)

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + toks(text)
        return sum(math.log10(self.prob(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


@pytest.mark.parametrize("order,share", [(2, 64), (3, 64), (3, 8), (3, 10**9), (4, 30), (5, 64)])
def test_higher_orders(spark, monkeypatch, order, share):
    from cellgrid.llm.common import fold

    monkeypatch.setattr(k, "HOT_SHARE", share)
    monkeypatch.setattr(k, "BLOCK_BYTES", 600)
    rng = random.Random(order)
    vocab = [f"w{i}" for i in range(12)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 30)))) for i in range(200)]
    rows += [(300, None), (301, ""), (303, "UNSEEN words W1 w2 w0 w0"), (None, "w1 w2 never w1 w0"), (5, rows[5][1]), (310, rows[310 % 200][1]), (304, "w3 w4 " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    part = fold("doc_id", 10)
    scores, model = k.katz_scores(df, part != 0, part == 0, order=order)
    plain = PlainHigher([t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 != 0], order)
    want = sorted((str(d), plain.score(t)) for d, t in rows)
    have = sorted((str(r["doc_id"]), r["score"]) for r in scores.collect())
    assert [x for x, _ in want] == [x for x, _ in have]
    assert np.allclose([x for _, x in want], [x for _, x in have], rtol=1e-9, atol=1e-9)
    for n in range(2, order + 1):
        stored = sum(int(k.stretch(r["counts"]).sum()) for r in model.where(f"`order` = {n}").collect())
        assert stored == sum(plain.grams[n].values())
        for h in list(plain.followers[n])[:20]:
            assert abs(sum(plain.prob(h, w) for w in plain.uni) + plain.prob(h, "no such word") - 1) < 1e-9


def test_order_below_two(spark):
    with pytest.raises(ValueError):
        run_order = k.katz_scores(spark.createDataFrame([], "doc_id long, text string"), k.F.lit(True), k.F.lit(False), order=1)
        assert run_order
