"""Whitening against numpy and exact integers."""

import math

import numpy as np
import pytest

from trackloom.llm import whitening


def by_force(rows, components=32):
    """The contract, by exact integers and LAPACK."""
    good = [(k, v) for k, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(row, s, strict=True)] for row in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return [k for k, _ in good], n, deviation, centred @ axes / np.sqrt(e), e / np.trace(v)


def check(got, rows, components=32):
    keys, n, deviation, white, explained = by_force(rows, components)
    assert len(got) == white.size
    table = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, k in enumerate(keys):
        for c in range(white.shape[1]):
            r = table[k, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
            assert r["identity_error"] < 1e-9
            if abs(white[i, c]) > 1e-3:
                signs.setdefault(c, r["whitened"] * white[i, c] > 0)
            assert math.isclose(r["whitened"], white[i, c] * (1 if signs.get(c, True) else -1), rel_tol=1e-6, abs_tol=1e-7)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64])
def test_eigen(size):
    rng = np.random.default_rng(size)
    for m in (rng.normal(size=(size, size)), np.eye(size), np.zeros((size, size)), np.diag(np.arange(size)), np.ones((size, size)), 1e8 * rng.normal(size=(size, 2)) @ np.ones((2, size))):
        m = m @ m.T
        e, axes = whitening.eigen(m)
        assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], rtol=0, atol=1e-13 * max(1.0, np.abs(m).max()) * size)
        assert np.abs(axes @ axes.T - np.eye(size)).max() < 1e-13 * size
        assert np.abs(axes.T * e @ axes - m).max() <= 1e-13 * max(1.0, np.abs(m).max()) * size
        assert (np.diff(e) <= 0).all()


def test_merged_states_equal_one_pass():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(1e6, 50, (500, 6)))
    one = whitening.Moments(6)
    one.add(rows)
    one.count(rows.astype(np.int64))
    parts = []
    for part in np.split(rows, [3, 3, 200]):
        parts.append(whitening.Moments(6))
        parts[-1].add(part)
        parts[-1].count(part.astype(np.int64))
    for p in parts[1:]:
        parts[0].merge(p)
    assert parts[0].n == 500 and parts[0].sums == one.sums == rows.astype(int).sum(axis=0).tolist()
    assert np.allclose(parts[0].covariance, np.cov(rows.T, bias=True), rtol=1e-12) and np.allclose(one.covariance, parts[0].covariance, rtol=1e-12)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_against_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    data = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(data)] + [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [1.0, float("inf"), 0, 0, 0])]
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    check(whitening.digest(df, "vec_id").collect(), rows)


def test_components_and_extra_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=40).tolist()) for k in range(100)]
    df = spark.createDataFrame([(k, v, "own", 7) for k, v in rows], "vec_id long, embedding array<double>, whitened string, deviation int")
    check(whitening.digest(df, "vec_id").collect(), rows)
    made = whitening.fit(df).transform(df)
    assert made.columns == ["vec_id", "embedding", "whitened", "deviation", "_whitened", "_deviation"]
    assert {(r["whitened"], r["deviation"], len(r["_whitened"])) for r in made.collect()} == {("own", 7, 32)}


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        assert whitening.digest(spark.createDataFrame(rows, schema), "vec_id").collect() == []


def test_ties_repeats_nulls_and_lengths(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0]), (6, [1.0, 2.0, 3.0])]
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id").collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((k, c) for k in (1, 1, 0, 3, 4) for c in (1, 2))
    assert {r["n"] for r in got} == {5}


def test_rank(spark):
    """A dimension that never varies and one that follows another have no component of their own."""
    rng = np.random.default_rng(9)
    rows = [(k, [float(a), float(a), 2.0, float(b)]) for k, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)))]
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id").collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_exact_beyond_a_long():
    made = whitening.Whitening(10**12, [5 * 10**14, 0], 64, np.array([1.0]), np.array([[1.0, 0.0]]), 1.0)
    squares, centred = made.deviations(np.array([[500.0, 1.0], [501.0, 2.0**40]]))
    assert squares == [None, None] and centred[0].tolist() == [0.0, 1.0]
    assert made.deviations(np.array([[500.0, 0.0]]))[0] == [0]


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])]
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id").collect()
    assert {r["component"] for r in got} >= {1} and all(math.isfinite(r["whitened"]) for r in got)


def test_query(spark, sf, docs):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(whitening.query(spark, sf).collect(), rows)
