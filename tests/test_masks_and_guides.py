"""Masks, guides, constrained lines, UTM zones and the table function against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry, tables
from trackloom.operators import evidence, graph, guides, lines, masks


def label(on, diagonal):
    """The first pixel of each component, by filling."""
    out, near = {}, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (diagonal or not i or not j)]
    for p in sorted(on):
        if p in out:
            continue
        todo, out[p] = [p], p
        while todo:
            r, c = todo.pop()
            for i, j in near:
                q = (r + i, c + j)
                if q in on and q not in out:
                    out[q] = p
                    todo.append(q)
    return out


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize(("tile", "share", "few"), [(4, 0.55, 0), (4, 0.4, 200_000), (7, 0.3, 200_000), (256, 0.5, 200_000), (1, 0.5, 200_000)])
def test_components(spark, monkeypatch, diagonal, tile, share, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(tile)
    on = {k: {(i, j) for i in range(20) for j in range(23) if r.random() < share} for k in (0, 5)}
    rows = [(k, *p) for k, s in on.items() for p in s]
    df = spark.createDataFrame(rows + rows[:9] + [(None, 1, 1), (0, None, 2)], "image long, row long, col long")
    got = {(x.image, x.row, x.col): x.component for x in masks.mask_components(df, diagonal, tile).collect()}
    assert got == {(k, *p): (k << 40) + (q[0] << 20) + q[1] for k, s in on.items() for p, q in label(s, diagonal).items()}


def test_edges_follow_the_borders(spark, monkeypatch):
    """A mask that is set as a whole gives edges only along borders of tiles."""
    seen = []
    monkeypatch.setattr(masks, "components", lambda e: seen.append(e.count()) or graph.components(e))
    full = spark.range(64 * 64).select(F.lit(0).alias("image"), F.floor(F.col("id") / 64).alias("row"), (F.col("id") % 64).alias("col"))
    found = masks.mask_components(full, tile=16)
    assert found.select("component").distinct().count() == 1 and seen[0] <= 4 * 4 * 8  # pairs of tiles, not of pixels
    assert masks.mask_components(full.limit(0)).collect() == []
    with pytest.raises(Exception, match="rows and columns"):
        masks.mask_components(spark.createDataFrame([(0, -1, 0)], "image long, row long, col long")).collect()


def test_largest_small_and_morphology(spark):
    r = np.random.default_rng(4)
    a = r.random((30, 40)) < 0.6
    df = spark.createDataFrame([(0, int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)], "image long, row long, col long")
    as_mask = lambda d: {(x.row, x.col) for x in d.collect()}
    of = lambda m: {(int(i), int(j)) for i, j in zip(*np.nonzero(m), strict=True)}

    def moved(m, reach, whole):
        p = np.pad(m, reach)
        views = [p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * reach + 1) for j in range(2 * reach + 1)]
        return np.logical_and.reduce(views) if whole else np.logical_or.reduce(views)

    assert as_mask(masks.eroded(df, 1)) == of(moved(a, 1, True)) and as_mask(masks.dilated(df, 2, 30, 40)) == of(moved(a, 2, False))
    assert as_mask(masks.opened(df, 1, 30, 40)) == of(moved(moved(a, 1, True), 1, False))
    assert as_mask(masks.closed(df, 1, 30, 40)) == of(moved(moved(a, 1, False), 1, True))
    sparse = df.filter("(row * 7 + col * 3) % 5 < 2")
    labels = label(as_mask(sparse), False)
    count = {q: list(labels.values()).count(q) for q in set(labels.values())}
    found = masks.mask_components(sparse, diagonal=False, tile=8)
    best = min(count, key=lambda q: (-count[q], q))
    assert as_mask(masks.largest(found)) == {p for p, q in labels.items() if q == best}
    assert as_mask(masks.without_small(found, 3)) == {p for p, q in labels.items() if count[q] >= 3}


def upright(x, low, high, line):
    return [(line, k, float(x), float(y)) for k, y in enumerate(np.arange(low, high + 1, 10.0))]


def test_guide_takes_the_track_with_neighbours(spark):
    rows = upright(-5, 0, 1000, 1) + upright(0, 0, 1000, 2) + upright(5, 250, 900, 3)
    for turn in (0.0, 0.3):
        c, s = math.cos(turn), math.sin(turn)
        df = spark.createDataFrame([(i, k, x * c - y * s, x * s + y * c) for i, k, x, y in rows], "line_id long, seq int, x double, y double")
        guide, told = guides.evidence_guide(df, least=10, overlap=200.0)
        back = [(x * c + y * s, -x * s + y * c) for x, y in ((guide.x0, guide.y0), (guide.x1, guide.y1))]
        assert all(abs(x) < 0.25 for x, _ in back) and guide.length > 950 and told["two_sided"] and told["peaks"] == 3


def test_guide_without_neighbours_takes_the_longest(spark):
    rows = upright(-5, 0, 200, 1) + upright(0, 0, 1000, 2)
    guide, told = guides.evidence_guide(spark.createDataFrame(rows, "line_id long, seq int, x double, y double"), least=10, overlap=200.0)
    assert abs(guide.x0) < 0.25 and guide.length > 950 and not told["two_sided"]
    with pytest.raises(ValueError, match="no segments"):
        guides.evidence_guide(spark.createDataFrame([], "line_id long, seq int, x double, y double"))


def test_best_angle_against_numpy(spark):
    r = np.random.default_rng(2)
    x = r.uniform(0, 200, 600)
    p = np.column_stack([x, 0.02 * x + r.choice([0.0, 4.0, 9.0], 600) + r.normal(0, 0.03, 600)])
    df = spark.createDataFrame(pd.DataFrame(p, columns=["x", "y"]))

    def score(a):
        t = p[:, 1] * math.cos(a) - p[:, 0] * math.sin(a)
        bins = np.floor(t / 0.2).astype(int)
        n = np.bincount(bins - bins.min(), minlength=1)
        n = np.pad(n, 2)
        smooth = np.array([n[k - 2 : k + 3].sum() / 5 for k in range(2, len(n) - 2)])[n[2:-2] > 0]
        return (np.sort(smooth)[::-1][:8] ** 2).sum()

    angles = [0.01 + k * 0.0005 for k in range(41)]
    best = max(score(a) for a in angles)
    assert guides.best_angle(df, 0.02, 0.01, 0.0005, 0.2) == pytest.approx(min(a for a in angles if score(a) >= best - 1e-9))


def constrained_by_hand(c, g):
    """(s, t) of one key, step by step."""
    if len(c) < 2 or len(g) < 2:
        return sorted(c)
    ease = lambda a, b, power: [(a[0] + (b[0] - a[0]) * k / (n - 1), a[1] + (b[1] - a[1]) * ((k / (n - 1)) ** power) ** 2 * (3 - 2 * (k / (n - 1)) ** power)) for n in [max(2, math.ceil(abs(b[0] - a[0])) + 1)] for k in range(n)]
    c0, g0, c1, g1 = min(c), min(g), max(c, key=lambda x: (x[0], -x[1])), max(g, key=lambda x: (x[0], -x[1]))
    out, early = [], False
    if 0 < g0[0] - c0[0] <= 45:
        out += ease(c0, g0, 1.0)[:-1]
    out += sorted(g)
    if 0 < c1[0] - g1[0] <= 45:
        early = abs(c1[1] - g1[1]) > 1.2
        out += ease(g1, c1, 0.35 if early else 1.0)[1:]
    kept = []
    for p in sorted(out):
        if kept and p[0] - kept[-1][0] < 1e-6:
            kept.pop()
        kept.append(p)
    if not early or len(kept) < 5:
        return kept
    a, b = kept[0][0], kept[-1][0]
    n = max(5, math.ceil((b - a) / 0.75) + 1)
    s = [a + (b - a) * k / (n - 1) for k in range(n)]
    t = list(np.interp(s, [p[0] for p in kept], [p[1] for p in kept]))
    for _ in range(4):
        t = [t[k] if k < 2 or k > n - 3 else float(np.mean(t[max(0, k - 2) : k + 3])) for k in range(n)]
    return list(zip(s, t, strict=True))


def test_constrained_lines_against_hand(spark):
    r = random.Random(6)
    c, g = {}, {}
    for key in range(40):
        a = r.uniform(0, 50)
        c[key] = [(a + 5 * k, r.uniform(0, 3)) for k in range(r.randrange(1, 14))]
        g[key] = [(a + r.choice((-10, 3, 20, 60)) + 3 * k, r.uniform(0, 3)) for k in range(r.randrange(1, 9))]
    df = lambda d: spark.createDataFrame([(k, *p) for k, v in d.items() for p in v], "key long, s double, t double")
    got = evidence.constrained(df(c), df(g), ["key"]).toPandas().sort_values(["key", "place"])
    assert {"prefix", "suffix", "gauge", "smoothed", "candidate"} == set(got["kind"])
    for key in c:
        mine = got[got["key"] == key][["s", "t"]].to_numpy()
        assert np.allclose(mine, np.array(constrained_by_hand(c[key], g[key])), atol=1e-9)
        assert (np.diff(mine[:, 0]) > 0).all()  # no fold back


def test_utm(spark):
    at = [(lon, lat) for lon in (111.0, 114.5, 117.0, 119.9, 123.0) for lat in (-79.0, -33.3, -0.001, 0.0, 12.0, 45.0, 60.0, 83.9)]
    df = spark.createDataFrame(at, "lon double, lat double")
    for south in (False, True):
        back = geometry.from_utm(geometry.to_utm(df, 50, south), 50, south, lon="lon2", lat="lat2").toPandas()
        assert (back["lon"] - back["lon2"]).abs().max() < 1e-11 and (back["lat"] - back["lat2"]).abs().max() < 1e-11  # a micrometre and less
    x, y = geometry.utm_forward(F.col("lon"), F.col("lat"), 50)
    near = geometry.to_utm(df, 50).filter("abs(lon - 117) < 3").select("x", "y", x.alias("ox"), y.alias("oy")).toPandas()
    assert (near["x"] - near["ox"]).abs().max() < 0.01 and (near["y"] - near["oy"]).abs().max() < 0.01
    equator = geometry.to_utm(spark.createDataFrame([(117.0, 0.0), (117.0, 45.0)], "lon double, lat double"), 50).collect()
    assert (equator[0].x, equator[0].y) == (pytest.approx(500000), pytest.approx(0)) and equator[1].y == pytest.approx(4982950.400, abs=1e-3)
    assert geometry.utm_zone(32733) == (33, True)
    with pytest.raises(ValueError):
        geometry.utm_zone(3857)


def test_boxes_hold_what_was_in_them(spark):
    r = np.random.default_rng(8)
    boxes = [(k, x, x + w, y, y + h) for k, (x, y, w, h) in enumerate([(500000, 4400000, 1000, 1000), (300000, 6500000, 90000, 70000), (650000, 100000, 50000, 200000)])]
    df = spark.createDataFrame([(k, *map(float, b)) for k, *b in boxes], "k long, x_min double, x_max double, y_min double, y_max double")
    for target in (32651, 4326):
        new = {b.k: b for b in geometry.reprojected_boxes(df, 32650, target).collect()}
        pts = [(k, float(x), float(y)) for k, a, b, c, e in boxes for x, y in np.vstack([r.uniform((a, c), (b, e), (400, 2)), np.column_stack([r.uniform(a, b, 200), np.full(200, r.choice([c, e]))])])]
        for p in geometry.reprojected(spark.createDataFrame(pts, "k long, x double, y double"), 32650, target).collect():
            b = new[p.k]
            assert b.x_min <= p.x <= b.x_max and b.y_min <= p.y <= b.y_max
        assert new[0].x_max - new[0].x_min < (1200 if target == 32651 else 0.02)


def test_densify_line(spark):
    r = random.Random(1)
    rows = [(f"l{k}", q, r.uniform(0, 50), r.uniform(0, 50)) for k in range(20) for q in range(r.randrange(1, 7))] + [("same", 0, 1.0, 1.0), ("same", 1, 1.0, 1.0)]
    v = spark.createDataFrame(rows, "line_id string, seq int, x double, y double").repartition(5)
    v.createOrReplaceTempView("v")
    tables.register(spark)
    expected = lines.densify(v, 7.0).select("line_id", "k", "station", "x", "y").toPandas().sort_values(["line_id", "k"]).reset_index(drop=True)
    got = spark.sql("SELECT * FROM densify_line(TABLE(v) PARTITION BY line_id ORDER BY (seq), 7.0D)").toPandas().sort_values(["line_id", "k"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, atol=1e-9)
    with pytest.raises(Exception, match="spacing is positive"):
        spark.sql("SELECT * FROM densify_line(TABLE(v) PARTITION BY line_id ORDER BY (seq), -1.0D)").collect()
