"""Turnouts: the programme against all ways, the query against a plain version, and clouds made by seed."""

import itertools
import os
import random

import numpy as np
import pandas as pd
import pytest

from trackloom import catalog
from trackloom.functions.geometry import Frame
from trackloom.operators import turnouts
from trackloom.plans.centreline import Config
from trackloom.plans.turnouts import turnout

RULE = turnouts.Tracing(least_slices=2)


def price(a, b, rule):
    """What a step from candidate a to b costs, or None if it is not allowed. Candidates: (slice, s, t, z, gain)."""
    ds, dt = b[1] - a[1], abs(b[2] - a[2])
    if ds <= 1e-6 or ds > rule.most_gap or dt > max(rule.least_move, rule.move_per_metre * ds + rule.move_slack):
        return None
    return rule.lateral_weight * dt + rule.gap_weight * max(0.0, ds - rule.slice_length) + rule.height_weight * abs(b[3] - a[3])


def total_of(way, rule):
    out = way[0][4]
    for a, b in itertools.pairwise(way):
        p = price(a, b, rule)
        if p is None:
            return None
        out += b[4] - p
    return out


def test_best_total_over_all_ways():
    r = random.Random(2)
    for _ in range(25):
        rows = sorted((k, k + r.random(), r.choice((0.0, 0.3, 0.9)) + r.random() / 10, r.random(), r.random() * 3) for k in range(6) for _ in range(r.randrange(0, 3)))
        if not rows:
            continue
        number, s, t, z, gain = (np.array(c, float) for c in zip(*rows, strict=True))
        ways = turnouts.Ways(number.astype(int), s, t, z, gain, RULE)
        groups = [[x for x in rows if x[0] == k] + [None] for k in range(6)]
        best = {}
        for pick in itertools.product(*groups):
            way = [x for x in pick if x]
            if way and (score := total_of(way, RULE)) is not None:
                best[way[-1]] = max(best.get(way[-1], -np.inf), score)
        assert np.allclose(ways.total, [best[x] for x in rows])
        for k in range(len(rows)):
            assert total_of([rows[i] for i in ways.to(k)], RULE) == pytest.approx(ways.total[k])


def plain(rows, rule):
    """(role, slice, s, t) of one region, written for reading: rows are (slice, s, t, z, score)."""
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(x)
    cands = []
    for k in sorted(by):
        best = sorted(by[k], key=lambda x: (-x[4], x[2]))[: rule.most_candidates]
        low, high = min(x[4] for x in best), max(x[4] for x in best)
        cands.append([(*x[:4], rule.length_weight + rule.score_weight * (0.5 if high - low <= 1e-9 else (x[4] - low) / (high - low))) for x in best])

    def search(groups, most):
        total, back, order = {}, {}, []
        for g, group in enumerate(groups):
            for x in group:
                total[x], back[x] = x[4], None
                order.append(x)
                for earlier in reversed(groups[:g]):
                    for y in earlier:
                        p = price(y, x, rule)
                        if p is not None and total[y] + x[4] - p > total[x] + 1e-12:
                            total[x], back[x] = total[y] + x[4] - p, y
        kept = []
        for x in sorted(order, key=lambda x: -total[x]):
            way, k = [], x
            while k:
                way.append(k)
                k = back[k]
            way.reverse()
            if len(way) < rule.least_slices:
                continue
            mine = {y[0]: y[2] for y in way}
            if any(len(mine.keys() & o.keys()) >= 3 and np.median([abs(mine[q] - o[q]) for q in mine.keys() & o.keys()]) < rule.alike for _, _, o in kept):
                continue
            kept.append((total[x], way, mine))
            if len(kept) == most:
                break
        return kept

    ways = search(cands, rule.main_ways)
    if not ways:
        return []
    main = ways[0][1]
    ms, mt = [x[1] for x in main], [x[2] for x in main]
    off = lambda x: x[2] - np.interp(x[1], ms, mt)
    best = None
    for score, way, _ in search([[x for x in g if abs(off(x)) >= rule.apart] for g in cands], rule.branch_ways):
        value = turnouts.branch_score(score, np.array([x[1] for x in way]), np.array([off(x) for x in way]), rule)
        if value is not None and (best is None or value > best[0]):
            best = (value, way)
    out = [("main", x[0], x[1], x[2]) for x in main]
    if best:
        before = [x for x in main if x[1] < best[1][0][1] - 1e-6]
        switch = max(before, key=lambda x: x[1]) if before else min(main, key=lambda x: abs(x[1] - best[1][0][1]))
        out += [("branch", x[0], x[1], x[2]) for x in [switch, *best[1]]]
    return out


def test_regions_against_plain(spark):
    r = np.random.default_rng(5)
    rows = []
    for region in range(12):
        for k in range(40):
            for _ in range(r.integers(0, 4)):
                rows.append((region, k, k + float(r.random()), float(r.choice([0.0, 0.05 * k, 3.0])) + float(r.normal(0, 0.1)), float(r.normal(0, 0.05)), float(r.random())))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["region", "slice", "s", "t", "z", "score"]))
    got = turnouts.turnouts(df, ["region"]).toPandas().sort_values(["region", "role", "place"], ascending=[True, False, True])
    some = 0
    for region in range(12):
        expected = plain([x[1:] for x in rows if x[0] == region], turnouts.Tracing())
        mine = got[got["region"] == region]
        assert [tuple(x) for x in mine[["role", "slice", "s", "t"]].itertuples(index=False)] == expected
        some += any(x[0] == "branch" for x in expected)
    assert some > 3


def test_defined_results(spark):
    schema = "region long, slice long, s double, t double, z double, score double"
    assert turnouts.turnouts(spark.createDataFrame([], schema), ["region"]).collect() == []
    rows = [(None if k % 2 else 1, j, float(j), 0.0, None, 1.0) for k in range(2) for j in range(8)] + [(1, 3, None, 0.0, 0.0, 1.0), (1, None, 3.0, 0.0, 0.0, 1.0), (1, 3, 3.0, float("nan"), 0.0, 1.0), (1, 4, 4.0, 0.0, 0.0, 1.0), (2, 1, 1.0, 1.0, 1.0, 1.0)]
    got = turnouts.turnouts(spark.createDataFrame(rows, schema), ["region"]).collect()
    assert sorted((x["region"] or 0, x["slice"]) for x in got) == sorted((k, j) for k in (0, 1) for j in range(8))


def test_anchor_moves_the_main_track(spark):
    rows = [(1, k, float(k), t, 0.0, s) for k in range(12) for t, s in ((0.0, 2.0), (4.0, 1.0))]
    df = spark.createDataFrame(rows, "region long, slice long, s double, t double, z double, score double")
    main = lambda a: {x["t"] for x in turnouts.turnouts(df, ["region"], anchors=a).filter("role = 'main'").collect()}
    assert main(None) == {0.0}
    assert main(spark.createDataFrame([(1, "main", 0.0, 4.1), (1, "main", 11.0, 4.1)], "region long, role string, s double, t double")) == {4.0}


def cloud(seed, length, many, slope, distractor):
    r = np.random.default_rng(seed)
    s = np.linspace(0, length, many)
    z = 0.012 * np.sin(s / 12)

    def around(at, centre, height, repeats, side):
        out = np.repeat(np.column_stack([at, centre, height]), repeats, axis=0)
        return out + r.normal(0, [0.08, side, 0.01], out.shape)

    parts = []
    after, far = s >= 14, s >= 28
    for at, centre, height in [(s, 0 * s, z), (s[after], slope * (s[after] - 14), z[after])] + ([(s[far], 0 * s[far] + 3.8, z[far])] if distractor else []):
        parts += [around(at, centre + side, height + 0.08, 6, 0.025) for side in (-0.75, 0.75)]
    parts.append(around(s[after], slope * (s[after] - 14) + 0.28, z[after] + 0.085, 4, 0.022))
    ballast = around(s, 0 * s, 0 * s - 0.04, 8, 0.01)
    ballast[:, 1] = r.uniform(-1.5, 1.5, len(ballast))
    local = np.vstack([*parts, ballast])
    a = np.radians(20)
    xy = local[:, :2] @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + [10, 20]
    return pd.DataFrame({"track": "one", "x": xy[:, 0], "y": xy[:, 1], "z": local[:, 2] + 2}), Frame(10, 20, 2, np.cos(a), np.sin(a))


@pytest.mark.parametrize(("seed", "length", "many", "slope", "distractor", "least", "most"), [(17, 42.0, 168, 0.095, False, 1.4, 3.2), (37, 58.0, 232, 0.065, True, 1.3, 3.2)])
def test_cloud(spark, seed, length, many, slope, distractor, least, most):
    points, frame = cloud(seed, length, many, slope, distractor)
    config = Config(gauge=1.5, tolerance=0.3, slice_length=0.8, least_points=12)
    got = turnout(spark.createDataFrame(points), frame, config).toPandas().sort_values(["role", "place"])
    main, branch = got[got["role"] == "main"], got[got["role"] == "branch"]
    assert len(main) > 10 and len(branch) > 6
    assert abs(main["t"].tail(5).median()) < 0.35
    assert least < branch["t"].tail(5).median() < most
    start = branch.iloc[0]
    assert start["t"] == pytest.approx(np.interp(start["s"], main["s"], main["t"]), abs=1e-9)
    x, y = start["x"] - 10, start["y"] - 20
    assert x * frame.ux + y * frame.uy == pytest.approx(start["s"], abs=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    d = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{d}/lineitem.parquet").toPandas()
    t["s"] = (pd.to_datetime(t["l_shipdate"]).dt.normalize() - pd.Timestamp("1992-01-01")).dt.days / 30
    got = catalog.QUERIES["turnout_paths"](spark, d).toPandas().sort_values(["role", "place"], ascending=[False, True])
    assert len(got) > 100
    for region, rows in t.groupby("l_suppkey"):
        expected = plain([(int(np.floor(x.s)), x.s, x.l_quantity / 20, x.l_tax, x.l_extendedprice) for x in rows.itertuples()], turnouts.Tracing())
        mine = got[got["region"] == region]
        assert [(x.role, x.slice, round(x.s, 9), round(x.t, 9)) for x in mine.itertuples()] == [(a, b, round(c, 9), round(e, 9)) for a, b, c, e in expected]
