"""The queries of the language and the quality model against scorers in plain Python that share no code with them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from cellgrid.llm import queries as q

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_language_id(spark):
    docs = rows_of(spark, "documents")
    rest = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    train = [r for r in docs if rest(r) and r["lang"] is not None and r["text"]]
    langs = sorted({r["lang"] for r in train})
    assert all(sum(len(r["text"]) for r in train if r["lang"] == x) < 3_000_000 for x in langs)  # so the sample is all of it
    counts = {x: Counter(w for r in train if r["lang"] == x for w in words(r["text"])) for x in langs}
    pieces = lambda w, n: [s[i : i + n] for s in [f"^{w}$" if n > 1 else w] for i in range(len(s) - n + 1)]
    grams = {x: Counter({}) for x in langs}
    for x in langs:
        for w, n in counts[x].items():
            for size in range(1, 6):
                for g in pieces(w, size):
                    grams[x][g] += n
    known = {w for x in langs for w in counts[x] if sum(c[w] for c in counts.values()) >= 2}
    near = {g for x in langs for g in grams[x] if sum(c[g] for c in grams.values()) >= 3}
    total = {(x, 0): sum(counts[x][w] for w in known) for x in langs} | {(x, n): sum(grams[x][g] for g in near if len(g) == n) for x in langs for n in range(1, 6)}
    size = {0: len(known)} | {n: sum(len(g) == n for g in near) for n in range(1, 6)}

    def log(x, item, order):
        seen = counts[x][item] if order == 0 else grams[x][item]
        return math.log((seen + 0.1) / (total[x, order] + 0.1 * (size[order] + 1)))

    def word(x, w):
        if w in known:
            return log(x, w, 0)
        for n in range(5, 0, -1):
            if got := [log(x, g, n) for g in pieces(w, n) if g in near]:
                return sum(got) / len(got)
        return 0.0

    found = {r["doc_id"]: r for r in q.op3_language_id(spark, SF).collect()}
    assert len(found) == len(docs)
    for r in docs:
        got = found[r["doc_id"]]
        assert got["held_out"] == (rest(r) == 0)
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        seen = Counter(words(r["text"]))
        logs = {x: sum(n * word(x, w) for w, n in seen.items()) for x in langs}
        best = max(logs.values())
        share = 1 / sum(math.exp(max(v - best, -700)) for v in logs.values())
        assert got["score"] == pytest.approx(share, abs=2e-3)
        if share > 0.51:
            assert got["lang_pred"] == max(langs, key=logs.get)


def test_quality(spark):
    docs = rows_of(spark, "documents")
    text = {r["doc_id"]: r["text"] for r in docs}
    marks = {r["doc_id"]: r["quality"] for r in rows_of(spark, "labels") if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and text.get(r["doc_id"])}
    assert len(text) == len(docs) and len(marks) < 4000
    part = {r["k"]: r["p"] for r in spark.createDataFrame([(k,) for k in marks], "k long").select("k", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(3)).alias("p")).collect()}
    blocks = lambda t: [t[i : i + 2048] for i in range(0, len(t), 2048)]
    sizes = []
    for y in (1, 0):
        own = sorted(text[k].encode() for k in marks if marks[k] == y and part[k] != 0)
        try:
            made = zstd.train_dictionary(110 * 1024, [b for t in own for b in blocks(t)], k=512, d=8).as_bytes()
        except zstd.ZstdError:
            made = b"\n".join(own)[-110 * 1024 :]
        coder = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(made), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(lambda t, coder=coder: sum(len(coder.compress(b)) for b in blocks(t)))
    feature = lambda t: 2 * (sizes[1](t) - sizes[0](t)) / (sizes[1](t) + sizes[0](t))
    curve = [k for k in marks if part[k] == 0]
    x, y = np.array([feature(text[k].encode()) for k in curve]), np.array([marks[k] for k in curve], float)
    a, b = np.zeros(2), x / x.std()
    for _ in range(20_000):  # plain gradient steps on the convex loss
        p = 1 / (1 + np.exp(-(a[0] * b + a[1])))
        a -= np.array([((p - y) * b).sum() + 1e-3 * a[0], (p - y).sum() + 1e-3 * a[1]]) * 2 / len(y)
    found = q.op7_quality(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        t = text[r["doc_id"]]
        z = (a[0] / x.std() * feature(t.encode()) if t else 0) + a[1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=0.02)
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
