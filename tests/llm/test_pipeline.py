"""Each stage against a plain version on its own input, and run() against the stages."""

import pytest

import corpus_pipeline as c
from cellgrid.llm import decontaminate as d
from cellgrid.llm import pii as p
from cellgrid.llm.packing import optimal_buckets
from cellgrid.llm.quality import fit_quality, training_rows
from cellgrid.llm.simhash_wide import SIMILARITY, shingle_set
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in c.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(x.columns == stages[0].columns and x.dtypes == stages[0].dtypes for x in stages[:5])
    for x in stages[:5]:
        assert x.where("n_chars <> length(text)").count() == 0


def test_quality(spark, stages):
    docs, kept = by_id(stages[0]), by_id(stages[1])
    model = fit_quality(training_rows(stages[0], spark.read.parquet(f"{SF}/labels.parquet")))
    score = model.scorer()
    assert set(kept) == {k for k, r in docs.items() if score(r["text"].encode()) >= c.REJECT_BELOW}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, y in labels.items() if y == 1]
    assert sum(k in kept for k in good) / len(good) > 0.95


def test_near_duplicates(stages):
    docs, kept = by_id(stages[1]), by_id(stages[2])
    ids = list(docs)
    narrow = plain_components(ids, [plain_fingerprint(docs[i]["text"]) for i in ids])
    sets = [set(shingle_set(docs[i]["text"].encode())) for i in ids]
    near = {i: [] for i in ids}
    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= SIMILARITY * len(sets[i] | sets[j]) > 0:
                near[ids[i]].append(ids[j])
    # components of both kinds of links
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, c in zip(ids, narrow, strict=True):
        for j in (c, *near[i]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert set(kept) == {find(i) for i in ids} and all(kept[k] == docs[k] for k in kept)


def test_decontamination(spark, stages):
    docs, kept = by_id(stages[2]), by_id(stages[3])
    items = [(str(r["item_id"]), d.words_of(r["text"].encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for _, w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}

    def hits(text):
        w = d.words_of(text.encode())
        return {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for p in range(i, i + n)}, len(w)

    for k, r in docs.items():
        hit, n = hits(r["text"])
        if not hit:
            assert kept[k] == r
        elif len(hit) > 0.5 * n:
            assert k not in kept
        else:
            left = [w for i, w in enumerate(d.words_of(r["text"].encode())) if i not in hit]
            assert d.words_of(kept[k]["text"].encode()) == left and not hits(kept[k]["text"])[0]


def test_pii(stages):
    docs, kept = by_id(stages[3]), by_id(stages[4])
    assert set(docs) == set(kept)
    for k, r in docs.items():
        base, added = p.find(r["text"])
        assert kept[k]["text"] == p.redact(r["text"], [*base, *added])


def test_packing(stages):
    rows = stages[5].collect()
    want = {}
    for r in stages[4].collect():
        n = len([w for w in r["text"].split(" ") for w in w.split()]) if r["text"] else 0
        want[r["doc_id"]] = n
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == {k: n for k, n in want.items() if n}
    hist = {}
    for r in rows:
        hist[r["n_tokens"]] = hist.get(r["n_tokens"], 0) + 1
    assert sum(r["padding"] for r in rows) == optimal_buckets(hist).padding


def test_run(spark, stages):
    a = sorted(map(str, c.run(spark, SF).collect()))
    b = sorted(map(str, stages[5].collect()))
    assert len(a) == len(b)
    strip = lambda rows: sorted((r["doc_id"], r["piece"], r["n_tokens"], r["bucket_len"]) for r in rows)
    assert strip(c.run(spark, SF).collect()) == strip(stages[5].collect())


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_documents(spark, tmp_path, kind):
    """No documents; then nulls in every column, blank and long texts, repeated ids and rows: nothing fails, and what is like nothing else stays."""
    rows = [] if kind == "empty" else [(i, f"some quiet text about the river number {i} and the old mill " * 3, "en", "web", 10) for i in range(6)]
    rows += [] if kind == "empty" else [(1, None, None, None, None), (None, "no id but text here", None, "web", None), (7, "", "en", "", 0), (7, "   ", "en", "", 3), (8, "long " * 50_000, "en", "web", 250_000), (8, "long " * 50_000, "en", "web", 250_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if kind == "empty" else 50).write.parquet(f"{tmp_path}/{name}.parquet")
    out = c.run(spark, str(tmp_path)).collect()
    assert not out if kind == "empty" else len([r for r in out if r["doc_id"] == 8]) == 50_000 // 2048 + 1
