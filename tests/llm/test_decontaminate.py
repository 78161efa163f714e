"""The automaton against a scan of all windows."""

import random

import pytest

from cellgrid.llm import decontaminate as d


def plain(words, items, window=10):
    hit, found = set(), set()
    for k, item in items:
        n = min(len(item), window)
        for g in {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == g:
                    hit.update(range(i, i + n))
                    found.add(k)
    return hit, found


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([b"a", b"b", b"c"][: rng.randrange(1, 4)])
    items = [(str(k), [word() for _ in range(rng.randrange(0, 9))]) for k in range(rng.randrange(1, 6))]
    machine = d.SuffixAutomaton(items, window=4)
    for _ in range(20):
        words = [rng.choice([b"a", b"b", b"c", b"zz"]) for _ in range(rng.randrange(0, 40))]
        spans, found = machine.read(words)
        want, keys = plain(words, items, 4)
        assert {p for a, b in spans for p in range(a, b)} == want
        assert found == keys
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


ITEM = "Alpha beta-gamma, delta epsilon zeta eta theta iota kappa lambda mu"


def frames(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short item ÉTÉ"), (3, ""), (4, None), (None, "never used words")], "item_id long, text string")
    docs = [
        (1, f"Before it. {ITEM.upper()} and after, with many more words than were taken so that the most of it remains here", "x"),
        (2, "nothing to see", "x"),
        (3, None, "x"),
        (4, "", "x"),
        (5, ITEM, "x"),
        (6, "a Short, item ÉTÉ! among other words of this text", "x"),
        (6, "a Short, item ÉTÉ! among other words of this text", "x"),
        (7, "delta epsilon zeta eta theta iota kappa lambda", "x"),
        (8, "never used words", None),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string, spans string"), bench


@pytest.mark.parametrize("max_chars", [30, 1_000_000])
def test_documents(spark, max_chars):
    docs, bench = frames(spark)
    got = d.contamination(docs, bench, max_chars=max_chars).collect()
    items = [("1", d.words_of(ITEM.encode())), ("2", d.words_of("short item ÉTÉ".encode()))]
    assert len(got) == docs.count()
    for r in got:
        text = {x["doc_id"]: x["text"] for x in docs.collect()}[r["doc_id"]]
        words = d.words_of(text.encode() if text is not None else None)
        hit, found = plain(words, items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(words), len(hit), sorted(found))


def test_cutting(spark):
    docs, bench = frames(spark)
    out = d.decontaminate(docs, bench)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 5 not in rows and rows[2] == "nothing to see" and rows[3] is None and rows[8] == "never used words"
    assert rows[1].startswith("Before it. and after") and "EPSILON" not in rows[1]
    assert out.where("doc_id = 6").count() == 2
    assert d.contamination(out, bench).where("n_hit > 0").count() == 0


def test_empty(spark):
    docs, bench = frames(spark)
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert d.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_repetitive_items_are_read_in_linear_time():
    import time

    words = [b"w"] * 80_000
    machine = d.SuffixAutomaton([("1", words)])
    began = time.perf_counter()
    assert machine.read(words) == ([(0, 80_000)], {"1"})
    assert time.perf_counter() - began < 5
