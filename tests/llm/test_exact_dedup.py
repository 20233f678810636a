"""Exact deduplication against a plain version."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.llm import base, exact_dedup


def by_force(rows, keep):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        real = [d for d in ids if d is not None]
        best = (max if keep == "largest" else min)(real) if real else None
        left = 1
        for d in ids:
            stays = d == best and left == 1
            left -= stays
            out.append((d, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=str)


def constant(sha256):
    return F.lit("0" * 16).cast("binary")


ROWS = [(k, t) for k, t in enumerate(["a", "b", "a", None, "", "a ", "A", "b", "ä", "ä", "x" * 50_000, "x" * 50_000, "x" * 49_999])] + [(2, "a"), (2, "a"), (None, "a"), (None, "only"), (None, "only"), (None, None)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("send", [base.BROADCAST_BYTES, 100])
@pytest.mark.parametrize("digest", [exact_dedup.half, constant])
def test_against_force(spark, monkeypatch, keep, send, digest):
    """A constant hash makes every text collide with all others; a small bound shuffles what else is sent."""
    monkeypatch.setattr(base, "BROADCAST_BYTES", send)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert rows_of(exact_dedup.decisions(docs, keep=keep, digest=digest)) == by_force(ROWS, keep)


def test_hot_group_is_sent_apart(spark, monkeypatch):
    monkeypatch.setattr(base, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(exact_dedup, "SHARE", 3)
    rows = [(k, "hot" if k % 2 else f"t{k // 4}") for k in range(400)]
    assert rows_of(exact_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string"))) == by_force(rows, "smallest")


def test_normalised(spark):
    docs = spark.createDataFrame([(3, "A b"), (1, "a B"), (2, "c")], "doc_id long, text string")
    got = exact_dedup.decisions(docs, normalise=F.lower)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()} == {(3, 1, False), (1, 1, True), (2, 2, True)}


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for keep in ("smallest", "largest"):
        assert rows_of(exact_dedup.decisions(odd, keep=keep)) == by_force(rows, keep)
    assert exact_dedup.decisions(none).collect() == []
    left = exact_dedup.deduplicated(odd.withColumns({c: F.lit("own") for c in ("hash", "stays", "own", "kept", "keep_id", "sha256", "id")}))
    assert {"hash", "stays", "own", "kept", "_row"} < set(left.columns)
    assert sorted((r["text"] or "") for r in left.collect()) == sorted({t or "" for _, t in rows})


def test_no_python_workers(docs):
    plan = exact_dedup.decisions(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, sf, docs):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    df = exact_dedup.query(spark, sf)
    expected = duckdb.sql(exact_dedup.ORACLE_SQL).df()
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df) == sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in expected.itertuples()), key=str)
    assert df.filter("not kept").count() > 0
