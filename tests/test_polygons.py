"""Unions of polygons: inside them is what is inside one of them."""

import math
import os
import random

import numpy as np
import pytest

from trackloom import catalog
from trackloom.operators import graph, polygons


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def table(spark, shapes):
    return spark.createDataFrame([(k, q, float(x), float(y)) for k, s in shapes.items() for q, (x, y) in enumerate(s)], "polygon_id long, seq int, x double, y double")


def rings_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.zone, r.ring, r.seq)):
        out.setdefault((r.zone, r.ring, r.area), []).append((r.x, r.y))
    return out


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_boxes(spark):
    shapes = {
        1: box(0, 0, 4, 4), 2: box(2, 2, 6, 6),  # overlap
        3: box(10, 0, 12, 2), 4: box(12, 0, 14, 2),  # share a side
        5: box(20, 0, 30, 10), 6: box(22, 2, 24, 4),  # one in the other
        7: box(40, 0, 42, 2), 8: box(42, 2, 44, 4),  # touch at a corner
        9: box(50, 0, 52, 2), 10: box(50, 0, 52, 2)[::-1],  # one twice, once the other way round
        11: box(60, 0, 66, 1), 12: box(60, 5, 66, 6), 13: box(60, 0, 61, 6), 14: box(65, 0, 66, 6),  # a frame around a hole
        15: [(70, 0), (71, 0)], 16: [(80, 0), (81, 0), (82, 0)],  # nothing
    }
    found = rings_of(polygons.union(table(spark, shapes), 3.0))
    areas = {}
    for (zone, _, area), _ in found.items():
        areas.setdefault(zone, []).append(round(area, 6))
    areas = {z: sorted(a) for z, a in areas.items()}
    assert areas == {1: [28.0], 3: [8.0], 5: [100.0], 7: [4.0, 4.0], 9: [4.0], 11: [-16.0, 36.0]}


@pytest.mark.parametrize(("seed", "few"), [(1, 200_000), (2, 200_000), (3, 0)])
def test_random_polygons_against_points(spark, monkeypatch, seed, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(seed)
    shapes = {}
    for k in range(40):
        cx, cy, n = r.uniform(0, 60), r.uniform(0, 60), r.randrange(3, 9)
        turns = [2 * math.pi * (q + r.uniform(0, 0.9)) / n for q in range(n)]  # seen from its centre, a simple polygon
        shapes[k] = [(cx + d * math.cos(a), cy + d * math.sin(a)) for a, d in ((a, r.uniform(2, 8)) for a in turns)][:: r.choice((1, -1))]
    found = rings_of(polygons.union(table(spark, shapes), 5.0))
    rings = list(found.values())
    g = np.random.default_rng(seed)
    wrong = 0
    for x, y in g.uniform(-5, 65, (6000, 2)):
        wrong += any(inside(x, y, s) for s in shapes.values()) != (sum(inside(x, y, s) for s in rings) % 2 == 1)
    assert wrong <= 2  # of 6000 random places none should lie within the rounding of an outline
    for ring in rings:
        assert len(set(ring)) == len(ring) >= 3
    assert any(a < 0 for _, _, a in found) or seed != 1


def test_defined_results(spark):
    assert polygons.union(table(spark, {}), 1.0).collect() == []
    odd = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, None, 5.0), (1, 3, 1.0, 1.0), (1, 4, 0.0, 0.0), (None, 0, 0.0, 0.0)], "polygon_id long, seq int, x double, y double")
    assert [a for _, _, a in rings_of(polygons.union(odd, 1.0))] == [pytest.approx(0.5)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    d = "/root/testdata/sf0.001"
    rings = rings_of(catalog.QUERIES["merged_zones"](spark, d))
    shapes = []
    for c in spark.read.parquet(f"{d}/customer.parquet").collect():
        h, cx, cy = 1 + c.c_nationkey / 10, c.c_acctbal / 200, c.c_custkey / 5
        shapes.append([(cx + h * a, cy + h * b) for a, b in ((-1.0, -0.5), (1.0, -1.0), (0.7, 1.0), (-0.6, 0.8))])
    g = np.random.default_rng(1)
    for x, y in g.uniform((-8, -3), (55, 35), (4000, 2)):
        assert any(inside(x, y, s) for s in shapes) == (sum(inside(x, y, s) for s in rings.values()) % 2 == 1)


def test_long_rings_are_put_in_order_tile_by_tile(spark, monkeypatch):
    """A long outline with holes along it, one zone: no task holds it whole, and the rows are those of one tile."""
    shapes, k = {}, 0
    for j in range(60):  # a ladder: two rails, a rung every four
        for s in (box(4 * j, 0, 4 * j + 5, 1), box(4 * j, 5 + j % 2, 4 * j + 5, 6 + j % 2), box(4 * j, 0, 4 * j + 1, 6 + j % 2)):
            shapes[k], k = s, k + 1
    shapes[k] = box(4 * 59 + 4, 0, 4 * 60 + 1, 1)
    shapes[k + 1], shapes[k + 2] = box(500, 0, 502, 2), box(502, 2, 504, 4)  # a place where two go on
    held, once = [], polygons.map_runs

    def seen(df, keys, *rest):
        held.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)
        return once(df, keys, *rest)

    monkeypatch.setattr(polygons, "map_runs", seen)
    rows = lambda: sorted(tuple(r) for r in polygons.union(table(spark, shapes), 3.0).collect())
    monkeypatch.setattr(polygons, "TILE", 4, raising=False)
    monkeypatch.setattr(polygons, "WIDER", 2, raising=False)
    monkeypatch.setattr(polygons, "RUNS", 8, raising=False)
    got = rows()
    assert len(held) > 3 and max(held) < len(got) / 5
    monkeypatch.setattr(polygons, "TILE", 10_000, raising=False)
    assert got == rows()
    rings = {}
    for zone, ring, hole, area, seq, x, y in got:
        rings.setdefault((zone, ring, hole, area), []).append((seq, x, y))
    assert sorted(r[:2] for r in rings) == [(0, n) for n in range(60)] + [(k + 1, 0), (k + 1, 1)]
    assert sum(hole for _, _, hole, _ in rings) == 59
    for (_, _, hole, area), places in rings.items():
        assert [p[0] for p in places] == list(range(len(places))) and hole == (area < 0)
        assert area == pytest.approx(0.5 * sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(places, places[1:] + places[:1], strict=True)))
        ways = [(*a[1:], *b[1:]) for a, b in zip(places, places[1:] + places[:1], strict=True)]
        assert min(ways) == ways[0]  # a ring starts at its least piece
