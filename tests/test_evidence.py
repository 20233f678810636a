"""Bands, transitions and connectors on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import evidence as e


def test_bands(spark):
    rows = spark.createDataFrame([(1, o, 1) for o in (-5.1, -5.0, 0.0, 0.1, 5.0, 5.4)], "k int, offset double, count long")
    got = e.band_clusters(rows, ["k"], 1.0, 5).orderBy("offset").collect()
    assert [r.band for r in got] == [0, 0, 1, 1, 2, 2]
    assert e.band_clusters(rows, ["k"], 1.0, 2).select("band").distinct().count() == 2


def test_transition(spark):
    rows = spark.createDataFrame([(1, s, t) for s, t in ((10.0, 0.0), (30.0, 1.0), (40.0, 2.0), (50.0, 3.0), (60.0, 4.0), (90.0, 5.0))], "k int, station double, offset double")
    got = e.transitions(rows, ["k"], 0.2, 4.8, 15.0).collect()
    assert len(got) == 1 and (got[0].s0, got[0].t1, got[0].n) == (30.0, 4.0, 4) and got[0].slope == pytest.approx(0.1)


def test_thinning(spark):
    t = spark.createDataFrame([(1, 0.0, 5), (1, 4.0, 9), (1, 20.0, 3)], "k int, s0 double, n int")
    assert sorted((r.s0, r.n) for r in e.one_per_start(t, ["k"]).collect()) == [(4.0, 9), (20.0, 3)]
    f = spark.createDataFrame([("p", "a", 0.0, 10.0, 0.0, 5.0, 0.9), ("p", "b", 2.0, 10.0, 0.0, 5.0, 0.8), ("p", "c", 20.0, 30.0, 0.0, 5.0, 0.1)], "pair string, evidence_id string, s0 double, s1 double, t0 double, t1 double, score double")
    assert sorted(r.evidence_id for r in e.distinct_evidence(f, "pair").collect()) == ["a", "c"]
    d = spark.createDataFrame([(1, x) for x in (0.01, 3.0, 3.02, 9.99)], "line int, d double")
    assert sorted(r.d for r in e.spaced(d, ["line"], "d", F.lit(10.0), 0.05).collect()) == [0.0, 3.0, 10.0]


def test_targets_and_zones(spark):
    p = spark.createDataFrame([(k, k % 3, float(k)) for k in range(100)], "id int, priority int, s double")
    got = e.review_targets(p, "priority", "s", 20.0, 4).collect()
    at = sorted(r.s for r in got)
    assert 0 < len(at) <= 4 and all(b - a >= 20 for a, b in zip(at, at[1:]))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 4.0, 4.0), (3, 3.5, 3.5, 5.0, 6.0), (4, 50.0, 0.0, 51.0, 1.0)], "box_id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in e.workzones(boxes, 2.0).collect()) == [(0.0, 0.0, 5.0, 6.0, 3), (50.0, 0.0, 51.0, 1.0, 1)]


def test_crossover_is_drawn_to_evidence(spark):
    ends = spark.createDataFrame([(1, 0.0, 40.0, 0.0, 5.0)], "line_id int, s0 double, s1 double, t0 double, t1 double")
    ev = spark.createDataFrame([(1, 20.0, 4.0, 1.0)], "line_id int, station double, offset double, confidence double")
    got = {r.k: r.offset for r in e.crossover(ends, ev, 20, 4.0).collect()}
    assert got[0] == 0.0 and got[20] == 5.0 and 3.5 < got[10] < 4.0 and got[5] < 1.0


def test_best_parameter_and_turns(spark):
    c = spark.createDataFrame([(1, w, k, w == 2 and k == 1, float(w)) for w in (2, 4, 6) for k in range(3)], "line int, w int, k int, bad boolean, p double")
    assert e.best_parameters(c, ["line"], "w", ~F.col("bad"), F.col("p")).first().w == 4
    v = spark.createDataFrame([(1, k, float(k), 3.0 if k == 2 else 0.0) for k in range(5)], "line int, k int, x double, y double")
    got = e.limited_turns(v, ["line"], "k", 20.0).orderBy("k").collect()
    assert got[0].y == 0.0 and got[4].y == 0.0 and got[2].y < 1.0


def test_partner_and_runs(spark):
    p = spark.createDataFrame([(1, 1.3, 5.0), (1, 1.5, 9.0), (1, 3.0, 99.0)], "k int, at double, v double")
    assert e.partner(p, ["k"], "at", "v", 1.5, 0.3).first()["at"] == 1.5
    s = spark.createDataFrame([(1, k, "a" if k < 3 else "b") for k in range(5)], "line int, k int, kind string")
    assert [(r.kind, r.start, r.n) for r in e.kinds_along(s, ["line"], "k", "kind").orderBy("start").collect()] == [("a", 0, 3), ("b", 3, 2)]
