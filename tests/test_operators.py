"""Operators on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import scalars as C
from trackloom.operators import aggregates, curves, dynamic, filters, frames, graph, lines, ranges, raster, sampling, sequences
from trackloom.sources import readers, writers
from trackloom.streaming import twins


def line(spark, *points, line_id=1):
    return spark.createDataFrame([(line_id, k, float(x), float(y)) for k, (x, y) in enumerate(points)], "line_id long, seq int, x double, y double")


def test_frame_round_trip_and_pca(spark):
    pts = spark.createDataFrame([(float(k), 2.0 * k, 1.0) for k in range(20)], "x double, y double, z double")
    frame = frames.pca_frame(pts)
    assert abs(math.atan2(frame.uy, frame.ux)) == pytest.approx(math.atan2(2, 1))
    back = frames.to_world(frames.to_local(pts, frame), frame).toPandas()
    assert np.allclose(back["y"], 2 * back["x"])
    with pytest.raises(ValueError):
        G.Guide(1, 1, 1, 1)


def test_affine_inverse(spark):
    a = G.Affine(0.05, 0.01, 100, 0.02, -0.05, 200)
    x, y = a.apply(F.lit(7.0), F.lit(9.0))
    c, r = a.inverse().apply(x, y)
    row = spark.range(1).select(c, r).first()
    assert row[0] == pytest.approx(7) and row[1] == pytest.approx(9)


def test_scalars(spark):
    row = spark.range(1).select(
        C.finite(F.lit("x"), -1.0), C.finite(F.lit("nan"), 2.0), C.threshold_byte(F.lit(0.5)), C.natural_key(F.lit("a10")) > C.natural_key(F.lit("a9")),
        C.radius_class(F.lit(520.0)), C.overlap_ratio(F.lit(0.0), F.lit(4.0), F.lit(3.0), F.lit(5.0)), C.path_key(F.lit("A\\B/C.png")),
    ).first()
    assert tuple(row) == (-1.0, 2.0, 128, True, "turnout_curve_range", 0.5, "c.png")


def test_shoelace(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))))
    assert spark.range(1).select(G.shoelace(ring)).first()[0] == 12.0


def test_densify_keeps_ends_and_length(spark):
    d = lines.densify(line(spark, (0, 0), (3, 0), (3, 4)), 1.0).orderBy("k").toPandas()
    assert (d["x"].iloc[0], d["y"].iloc[0]) == (0, 0) and (d["x"].iloc[-1], d["y"].iloc[-1]) == (3, 4)
    assert d["station"].iloc[-1] == pytest.approx(7)


def test_support(spark):
    samples = lines.sampled(line(spark, (0, 0), (20, 0)), 5.0)
    for y, ratio in ((0.2, 1.0), (5.0, 0.0)):
        seg = spark.createDataFrame([(0.0, y, 20.0, y)], "ax double, ay double, bx double, by double")
        got = lines.support(samples, seg, 0.85, 5.0, ["line_id"]).first()
        assert got.support_ratio == ratio
        assert got.max_unsupported == (0.0 if ratio else 25.0)


def test_clip(spark):
    got = lines.clip(line(spark, (0, 0), (10, 0), (20, 0)), F.lit(5.0), F.lit(12.0)).orderBy("s").toPandas()
    assert got["x"].tolist() == [5.0, 10.0, 12.0]


def test_interpolation_policies(spark):
    known = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0)], "k int, s double, v double")
    asked = spark.createDataFrame([(1, -1.0), (1, 5.0), (1, 12.0)], "k int, at double")
    read = lambda how: [r.v for r in ranges.interpolate(asked, known, "at", "s", "v", ["k"], how).orderBy("at").collect()]
    assert read("null") == [None, 10.0, None]
    assert read("clamp") == [0.0, 10.0, 20.0]
    assert read("extrapolate") == [-2.0, 10.0, 24.0]


def test_intervals_and_islands(spark):
    rows = spark.createDataFrame([("a", 0.0, 5.0), ("a", 4.0, 6.0), ("a", 20.0, 21.0)], "k string, lo double, hi double")
    got = sequences.merged_intervals(rows, ["k"], "lo", "hi", 1.0).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n) for r in got] == [(0.0, 6.0, 2), (20.0, 21.0, 1)]
    assert [(r.gap_start, r.gap_end) for r in sequences.gaps(rows, ["k"], "lo", "hi").collect()] == [(6.0, 20.0)]


def test_despike(spark):
    z = np.linspace(10, 11, 301)
    z[125:165] += 3
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(z)], "k int, s int, z double")
    got = sequences.despiked(rows, ["k"], "s", "z", 2, 60).toPandas()
    assert got["outlier"].sum() >= 35 and got["clean"].max() < 11.2


def test_monotone_slack_and_suppression(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5), (1, 2, 2.0)], "k int, s int, v double")
    assert [r.v for r in sequences.monotone_slack(rows, ["k"], "s", "v", 0.03).orderBy("s").collect()] == [1.0, 0.97, 2.0]
    peaks = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 6.0), (1, 5.0, 1.0)], "k int, at double, score double")
    assert sorted(r.at for r in sequences.suppressed(peaks, ["k"], "at", "score", 2.0).collect()) == [1.0, 5.0]


def test_quadratic_curvature(spark):
    rows = spark.createDataFrame([(1, float(s), s * s / 400.0) for s in range(-20, 21)], "k int, s double, t double")
    got = sequences.quadratic_curvature(rows, ["k"], "s", "t", 8).filter("s = 0").first()
    assert got.radius == pytest.approx(200, rel=1e-6)


def test_robust_fit_ignores_outliers(spark):
    pts = [(1, float(s), 0.01 * s + (5.0 if s % 10 == 0 else 0.001 * (s % 3))) for s in range(60)]
    got = aggregates.robust_fit(spark.createDataFrame(pts, "k int, station double, offset double"), ["k"]).first()
    assert got.slope == pytest.approx(0.01, abs=1e-3) and got.n_inliers == 54


def test_even_sample_matches_linspace(spark):
    for n, m in ((100, 7), (57, 56), (10, 10), (1000, 13)):
        got = sorted(r.id for r in sampling.even(spark.range(n).toDF("id"), "id", m).collect())
        assert got == (np.linspace(0, n - 1, m).astype(int).tolist() if m < n else list(range(n)))


def test_quotas_sum(spark):
    g = spark.createDataFrame([("a", 50), ("b", 30), ("c", 1)], "k string, n long")
    got = {r.k: r.quota for r in sampling.quotas(g, "k", "n", 20).collect()}
    assert sum(got.values()) == 21 - 1 + (1 if got["c"] == 1 and got["a"] + got["b"] == 20 else 0) and got["c"] == 1


def test_components_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 30 != 29], "a long, b long")
    got = graph.components(edges).toPandas()
    assert got["component"].nunique() == 10 + 1 - 1 and (got["component"] == got["node"] // 30 * 30).all()


def test_endpoint_anchor(spark):
    ends = spark.createDataFrame([(1, 10.12, 0.0, False), (2, 10.14, 0.0, True), (3, 50.0, 0.0, False)], "end_id long, x double, y double, accepted boolean")
    got = {r.end_id: (r.node, r.anchor_x) for r in graph.endpoint_clusters(ends, 0.25).collect()}
    assert got == {1: (1, 10.14), 2: (1, 10.14), 3: (3, 50.0)}


def test_disjoint_pairs(spark):
    rows = spark.createDataFrame([(0, float(x), s) for x, s in ((10, 0.9), (30, 0.8), (50, 0.8), (70, 0.9))], "y int, x double, score double")
    got = dynamic.best_disjoint_pairs(rows, ["y"], 10, 30, 20).orderBy("left").collect()
    assert [(r.left + r.right) / 2 for r in got] == [20.0, 60.0]


def test_disjoint_pairs_against_all_choices(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        x, s = np.sort(rng.uniform(0, 60, 7)), rng.uniform(0, 1, 7)
        conf = [0.5 * (s[k] + s[k + 1]) * max(0, 1 - abs(x[k + 1] - x[k] - 8) / 8) if 3 <= x[k + 1] - x[k] <= 15 else None for k in range(6)]
        best = max(sum(conf[k] for k in range(6) if m >> k & 1) for m in range(64) if not m & (m << 1) and all(conf[k] is not None for k in range(6) if m >> k & 1))
        rows = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, s, strict=True)], "y int, x double, score double")
        assert sum(r.confidence for r in dynamic.best_disjoint_pairs(rows, ["y"], 3, 15, 8).collect()) == pytest.approx(best)


def test_gauge_pairs(spark):
    rows = spark.createDataFrame([(0, o, 1.0) for o in (-0.8, 0.8, 4.2, 5.8, 2.5)], "k int, offset double, score double")
    got = dynamic.gauge_pairs(rows, ["k"], 1.6, 0.2, 4).orderBy("center").collect()
    assert [round(r.center, 6) for r in got] == [0.0, 5.0]


def test_linked_tracks(spark):
    rows = spark.createDataFrame([(0, float(s), c, 1.0) for s in range(12) for c in (0.0, 5.0)], "area int, station double, center double, score double")
    got = dynamic.linked_tracks(rows, ["area"], 2.0, 0.5, 0.1, 4, 3.0).groupBy("track").agg(F.avg("center").alias("c"), F.count("*").alias("n")).orderBy("c").collect()
    assert [(r.c, r.n) for r in got] == [(0.0, 12), (5.0, 12)]


def test_path_prefers_smooth():
    chosen = dynamic.path([np.array([1.0, 0.9])] * 4, [np.array([0.0, 1.0])] * 3 + [np.array([5.0, 1.0])])
    assert chosen == [1, 1, 1, 1]


def test_savgol_keeps_polynomials():
    x = np.arange(30.0)
    assert np.allclose(dynamic.savgol(0.5 * x**2 - x, 7, 2), 0.5 * x**2 - x)


def test_prominence():
    assert dynamic.prominences(np.array([0, 3, 1, 5, 0, 2, 0.0])).tolist() == [0, 2, 0, 5, 0, 2, 0]


def test_curves_end_where_they_should(spark):
    ends = spark.createDataFrame([(1, 0.0, 10.0, 1.0, 3.0, 0.0, 0.0)], "line_id int, s0 double, s1 double, t0 double, t1 double, m0 double, m1 double")
    for f in (curves.hermite, curves.eased, curves.curve_straight_curve):
        got = f(ends, 10).orderBy("k").toPandas()
        assert got["offset"].iloc[0] == pytest.approx(1) and got["offset"].iloc[-1] == pytest.approx(3)
    chord = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 20.0, 1.0, 0.3)], "line_id int, x0 double, y0 double, x1 double, y1 double, radius double, ux double, uy double")
    arc = curves.arcs(chord, 8).filter("side = 1").orderBy("k").toPandas()
    assert (arc["x"].iloc[-1], arc["y"].iloc[-1]) == (pytest.approx(10), pytest.approx(0, abs=1e-9)) and arc["y"].iloc[4] > 0


def test_side_fusion(spark):
    rows = [(1, k, 10.0, 10.1) for k in range(7)]
    rows[3] = (1, 3, 10.15, 30.0)
    got = curves.fused_z(spark.createDataFrame(rows, "line_id int, k int, left_z double, right_z double"), ["line_id"], "k").orderBy("k").collect()
    assert got[3].z == 10.15 and [r.how for r in got].count("context") == 1


def test_filters(spark):
    pts = spark.createDataFrame([(float(k), 0.0, float(k)) for k in range(10)], "x double, y double, z double")
    assert filters.inside(pts, x_min=2.0, x_max=5.0, y_min=None).count() == 4
    assert filters.highest(pts, 0.5).count() == 5
    with pytest.raises(Exception):  # noqa: B017
        filters.checked(pts, F.col("x") < 5, "too far").collect()


def test_raster(spark):
    pixels = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "row long, col long, value double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.1, 0.1)], "point_id int, x double, y double")
    got = {r.point_id: r.value for r in raster.bilinear(pts, pixels, G.Affine(1, 0, 0, 0, 1, 0)).collect()}
    assert got == {1: pytest.approx(5.5), 2: 0.0}
    assert [(r.row_off, r.col_off) for r in raster.tiles(10, 4, 4, 4, spark).orderBy("col_off").collect()] == [(0, 0), (0, 4), (0, 6)]


def test_files(spark, tmp_path):
    pts = spark.createDataFrame([(1.0, 2.0, 3.0), (4.5, 5.5, 6.5)], "x double, y double, z double")
    writers.xyz(pts, str(tmp_path / "p"))
    assert readers.text_points(spark, str(tmp_path / "p")).count() == 2
    feature = spark.createDataFrame([("f1", [(0, 1.0, 2.0), (1, 3.0, 4.0)], {"role": "main"})], "feature_id string, vertices array<struct<seq:int,x:double,y:double>>, props map<string,string>")
    writers.geojson(feature, str(tmp_path / "g"), 4326, one_file=True)
    got = readers.geojson(spark, str(tmp_path / "g"))
    assert [(r.seq, r.x, r.y) for r in readers.line_vertices(got).orderBy("seq").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    np.save(tmp_path / "a.npy", np.array([[1.0, 2, 3]]))
    assert readers.npy_points(spark, str(tmp_path)).first().y == 2.0
    xml = '<annotations><image id="0" name="t.png" width="20" height="10"><polygon label="rail" points="1,2;5,2;5,6;1,6"><attribute name="q">x</attribute></polygon><box label="b" xtl="0" ytl="0" xbr="2" ybr="2" z_order="3"/></image></annotations>'
    (tmp_path / "c.xml").write_text(xml)
    got = {r.kind: r for r in readers.annotations(spark, str(tmp_path / "c.xml")).collect()}
    assert len(got["polygon"].points) == 4 and got["polygon"].attributes == {"q": "x"} and got["box"].z_order == 3


def test_las(spark, tmp_path):
    import struct

    n, head = 3, bytearray(227)
    head[0:4], head[24], head[25], head[104] = b"LASF", 1, 2, 3
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<HI", head, 105, 34, n)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    struct.pack_into("<6d", head, 179, 100.2, 100.0, 200.0, 200.0, 5.0, 1.0)
    body = b"".join(struct.pack("<iiiHBBbBHdHHH", k * 10, 0, 100 + k, 100 + k, 0, 2, 0, 0, 0, 0.0, 1000, 2000, 3000) for k in range(n))
    (tmp_path / "a.las").write_bytes(bytes(head) + body)
    got = readers.las_points(spark, str(tmp_path)).orderBy("x").collect()
    assert [round(r.x, 6) for r in got] == [100.0, 100.1, 100.2] and got[0].classification == 2 and got[0].green == 2000
    h = readers.las_headers(spark, str(tmp_path))
    assert h.first().n == 3 and h.first().has_rgb and readers.pruned(h, 300, 400, 0, 1) == []


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(k, float(k % 5)) for k in range(50)], "k int, v double").selectExpr("timestamp_seconds(k) t", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, v double").parquet(str(tmp_path / "in"))
    q = twins.slice_counts(stream, "t", "10 seconds", "10 seconds", "v", 1.0).writeStream.format("memory").queryName("slices").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("slices").agg(F.sum("n")).first()[0] == 50


@pytest.mark.parametrize("lateral", ["free", "smooth"])
def test_centreline_of_a_synthetic_track(spark, lateral):
    from trackloom.plans import centreline as c

    pts, truth = c.synthetic(spark)
    got = c.centreline(pts, c.Config(lateral=lateral)).orderBy("slice").toPandas()
    a = np.radians(28)
    d = np.column_stack([got["x"] - 100, got["y"] + 30])
    s, t = d @ [np.cos(a), np.sin(a)], d @ [-np.sin(a), np.cos(a)]
    miss = t - np.interp(s, truth[:, 0], truth[:, 1])
    assert len(got) > 10 and np.sqrt((miss**2).mean()) < 0.25 and s.max() - s.min() > 20


def test_single_rail_is_inferred():
    import pandas as pd

    from trackloom.plans import centreline as c

    both = [{"left_at": -0.75, "right_at": 0.75, "pair_score": 5.0}]
    peaks = [{"at": -0.75, "score": 5.0}, {"at": 0.75, "score": 5.0}]
    rows = pd.DataFrame([(0, 0, 0.0, 100, 0.0, -9.0, 9.0, peaks, both), (0, 1, 1.0, 100, 0.0, -9.0, 9.0, peaks[:1], None), (0, 2, 2.0, 100, 0.0, -9.0, 9.0, None, None)], columns=["track", "slice", "s", "n", "z", "t_low", "t_high", "peaks", "pairs"])
    got = c.choose(rows, c.Config())
    assert got["pair_mode"].tolist() == ["dual", "single_left"] and got["t"].tolist() == [0.0, 0.0]


def test_stages(spark, tmp_path):
    from trackloom.plans import stages as st

    plan = [st.Stage("a", lambda s, t: s.range(3)), st.Stage("b", lambda s, t: t["a"].filter("id > 0"), ("a",))]
    status = lambda **k: [e["status"] for e in st.run(spark, plan, str(tmp_path), **k)]
    assert status(dry=True) == ["planned", "planned"]
    assert status(stop_after="a") == ["run", "skipped"]
    assert status() == ["kept", "run"] and spark.read.parquet(str(tmp_path / "b")).count() == 2
    with pytest.raises(ValueError):
        st.check(plan[::-1])


def test_positions_of_many_rows_with_a_payload(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=16).select((F.pmod(F.col("id") * 611_953, F.lit(n))).alias("id"), F.concat(F.lit("payload "), F.col("id") % 97).alias("payload"))
    got = sampling.positions(rows, "id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.sum((F.col("pos") != F.col("id")).cast("int")).alias("bad")).first()
    assert (got.n, got.d, got.m, got.bad) == (n, n, n - 1, 0)
    assert [r.id for r in sampling.even(rows, "id", 5).orderBy("id").collect()] == [0, (n - 1) // 4, (n - 1) // 2, 3 * (n - 1) // 4, n - 1]


def test_extrapolation_gathers_no_key(spark):
    n = 100_000
    known = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2.0).alias("s"), (F.col("id") * 6.0 + 1).alias("v"))
    at = spark.range(n + 200).select("id", F.lit(1).alias("k"), (F.col("id") * 2.0 - 101).alias("at"))
    out = ranges.interpolate(at, known, "at", "s", "v", ["k"], "extrapolate")
    assert out.count() == n + 200 and out.filter(F.abs(F.col("v") - (F.col("at") * 3 + 1)) > 1e-6).count() == 0
    one = ranges.interpolate(at.limit(3), known.limit(1), "at", "s", "v", ["k"], "extrapolate")
    assert one.filter("v is not null").count() == 0


def test_filling_costs_one_pass_a_key(spark):
    n = 100_000
    rows = spark.range(n).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 7 == 0, F.col("id") * 2.0).alias("v"))
    out = rows.select("id", sequences.filled(F.col("v"), ["k"], "id").alias("v"))
    assert out.filter(F.abs(F.col("v") - F.least(F.col("id"), F.lit((n - 1) // 7 * 7)) * 2) > 1e-6).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_either_way(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(few + 1)
    pairs = [(int(a) * 5 - 700, int(b) * 5 - 700) for a, b in rng.integers(0, 300, (220, 2))]
    top = {x: x for p in pairs for x in p}
    for _ in range(len(top)):
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top[x] for p in pairs if p[0] != p[1] for x in p}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0
