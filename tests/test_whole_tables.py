"""Queries over whole tables, against plain Python."""

import os

import numpy as np
import pytest

from trackloom import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{DATA}/lineitem.parquet").toPandas()


def by_force(edges):
    up = {}

    def top(k):
        up.setdefault(k, k)
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: top(k) for k in up}


def test_components_of_all_line_items(spark, items):
    got = {r.node: r.component for r in catalog.QUERIES["components_all"](spark, DATA).collect()}
    assert got == by_force(zip((2 * items.l_orderkey).tolist(), (2 * items.l_partkey + 1).tolist(), strict=True))
    assert len(got) == items.l_orderkey.nunique() + items.l_partkey.nunique()


def test_components_of_many_groups(spark, tmp_path):
    """Line items of a small fixture with chains, stars, repeats and a null."""
    rng = np.random.default_rng(3)
    rows = [(int(o), int(p)) for o, p in rng.integers(1, 150, (120, 2))] + [(200 + k, 300 + k + j) for k in range(40) for j in (0, 1)] + [(1, 1), (1, 1)]
    spark.createDataFrame([*rows, (None, 5), (7, None)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.component for r in catalog.QUERIES["components_all"](spark, str(tmp_path)).collect()}
    expected = by_force((2 * a, 2 * b + 1) for a, b in rows)
    assert got == expected and len(set(got.values())) > 5


def test_runs_of_all_line_items(spark, items):
    width = catalog.QUERIES["row_runs_all"](spark, DATA).toPandas()["width"].sum()
    assert width == (items.groupby(["l_orderkey", "l_linenumber"]).l_discount.max() >= 0.05).sum()


def test_support_of_whole_lines(spark, items):
    got = {r.line_id: r for r in catalog.QUERIES["support_metrics"](spark, DATA).collect()}
    v = items.groupby(["l_orderkey", "l_linenumber"], as_index=False).agg(x=("l_quantity", "min"), y=("l_extendedprice", "min"))
    s = spark.read.parquet(f"{DATA}/supplier.parquet").toPandas()
    a = np.stack([np.fmod(s.s_acctbal.astype(float), 50), s.s_suppkey % 30.0], 1)
    along = np.array([3.0, 4.0])
    many = v.groupby("l_orderkey").size()
    v = v[v.l_orderkey.isin(many.index[many > 1])]  # one vertex is no line
    assert set(got) == set(v.l_orderkey)
    for line, part in list(v.groupby("l_orderkey"))[:150]:
        xy = np.stack([part.x.astype(float), part.y.astype(float) / 1000], 1)
        at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
        stations = sorted({*(2.0 * k for k in range(int(at[-1] // 2) + 1)), at[-1]})
        points = np.stack([np.interp(stations, at, xy[:, k]) for k in (0, 1)], 1)
        t = np.clip(((points[:, None] - a) @ along) / 25, 0, 1)
        least = np.hypot(*(points[:, None] - a - t[..., None] * along).transpose(2, 0, 1)).min(axis=1)
        assert got[line].n_samples == len(stations)
        assert got[line].support_ratio == pytest.approx((least <= 2).mean(), abs=1e-3)
