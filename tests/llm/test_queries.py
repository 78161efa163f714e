"""The registered queries on the smallest tables: those with SQL beside DuckDB, others beside brute force."""

import hashlib

import duckdb
import pytest

from cellgrid.llm import queries as q
from cellgrid.llm.packing import optimal_buckets
from tests.llm.test_pii import plain
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", q.ORACLE_SQL)
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = db.execute(q.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in q.QUERIES[name](spark, SF).collect()))) == sorted(map(str, cursor.fetchall()))


def test_op4(spark, docs):
    ids = list(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    want = {(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, plain_components(ids, fps), strict=True)}
    assert {tuple(r) for r in q.op4_simhash(spark, SF).collect()} == want
    assert len({c for *_, c in want}) < len(want)


def test_op9(spark, docs):
    rows = q.op9_packing(spark, SF).collect()
    total, hist = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        hist[r["n_tokens"]] = hist.get(r["n_tokens"], 0) + 1
    words = {k: len([w for w in t.encode().split()]) for k, t in docs.items()}
    assert total == {k: n for k, n in words.items() if n}
    assert sum(r["padding"] for r in rows) == optimal_buckets(hist).padding
    assert len({(r["bucket_len"], r["batch"], r["slot"]) for r in rows}) == len(rows)


def test_op10(spark, docs):
    for r in q.op10_pii(spark, SF).collect():
        found = plain(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in found[k])
        assert tuple(r)[1:5] == tuple(len(found[k]) for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))
