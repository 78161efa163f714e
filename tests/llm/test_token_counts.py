"""Counts after edits against encoding the edited text afresh."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import token_counts as t
from cellgrid.llm.queries import op1_token_counts

ENCODER = t.Encoder(t._vocabulary(t.VOCABULARY))
PARTS = ["word", " ", "  ", "\n", "\n\n ", "'", "'l", "l", "'ll", "'s", "12", "3", "é", "ñandú", "!!", "?", "\t", " ", "漢字", "🙂", "-", "Zz"]


def full(text):
    return len(ENCODER.encoding.encode_ordinary(text))


def check(text, edits):
    counted = t.CountedText(text, ENCODER)
    assert counted.tokens == full(text)
    for at, size, new in edits:
        a = at % (len(text) + 1)
        b = min(len(text), a + size)
        text = text[:a] + new + text[b:]
        counted.edit(a, b, new)
        assert counted.text == text
        pieces = ENCODER.pattern.findall(text)
        assert [n for leaf in counted.tree.lengths for n in leaf] == [len(p) for p in pieces]
        assert counted.tokens == full(text)
        tree = counted.tree
        assert all(tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1] and tree.chars[i] == tree.chars[2 * i] + tree.chars[2 * i + 1] for i in range(1, tree.size))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 6), st.lists(st.sampled_from(PARTS), max_size=3).map("".join)), max_size=6))
def test_edits(text, edits):
    check(text, edits)


@pytest.mark.parametrize("seed", range(4))
def test_edits_of_long_texts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(PARTS, k=3000))
    check(text, [(rng.randrange(10**6), rng.choice([0, 1, 5, 900]), "".join(rng.choices(PARTS, k=rng.choice([0, 1, 3, 600])))) for _ in range(12)])


def test_edits_are_local():
    text = "some plain words here and there. " * 2000
    counted = t.CountedText(text, ENCODER)
    counted.edit(30000, 30004, "other")
    assert counted.tokens == full(counted.text) and counted.encoded < 12


def test_rows(spark):
    rows = [(1, "mail a@b.cd now", [(5, 11, "me")]), (1, "mail a@b.cd now", [(5, 11, "me")]), (2, None, [(0, 0, "x")]), (3, "", None), (None, "x y", []), (4, "w " * 60000, [(0, 1, "v"), (0, 1, "uu")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>").selectExpr("*", "'k' as edited")
    got = t.token_counts(df, edits="edits").collect()
    texts = ["mail me now"] * 2 + ["", "", "x y", "uu " + "w " * 59999]
    assert [r["n_tokens"] for r in got] == [full(x[1] or "") for x in rows]
    assert [r["n_tokens_edited"] for r in got] == [full(x) for x in texts]
    assert [r["n_edits"] for r in got] == [1, 1, 0, 0, 0, 2]
    assert [r["edited"] for r in got][:3] == ["mail me now", "mail me now", None]
    assert t.token_counts(df.limit(0), edits="edits").count() == 0


def test_query(spark):
    from cellgrid.llm.pii import detect

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_token_counts(spark, sf).collect()
    assert len(got) == len(texts) and any(r["n_edits"] for r in got)
    for r in got:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == full(text)
        for a, b, new in t.redaction_edits(text):
            text = text[:a] + new + text[b:]
        assert r["n_tokens_edited"] == full(text) and not any(detect(text).values())


def test_many_edits_of_a_long_text():
    """Edits over the borders of pieces and windows, against counting the whole text."""
    import random

    from cellgrid.llm import token_counts as t

    encoder, rng = t.Encoder(t._vocabulary(t.VOCABULARY)), random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "don't", "12", "...", "é", " " * 300, "x" * 200]) for _ in range(30_000))
    counted = t.CountedText(text, encoder)
    for _ in range(300):
        at = rng.randrange(len(text) + 1) if rng.random() < 0.5 else min(len(text), t.PIECE * rng.randrange(1, 8) + rng.randrange(-3, 4))
        end = min(len(text), at + rng.choice([0, 1, 5, 400]))
        new = rng.choice(["", " ", "<EMAIL>", "a b", "\n" * 200, "y" * 500])
        counted.edit(at, end, new)
        text = text[:at] + new + text[end:]
    assert counted.text == text and counted.tokens == sum(encoder.split(text)[1])
