"""Queries: frames, projections, filters, ranges and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as C
from ..operators import aggregates, filters, frames, lines, ranges, sampling
from .registry import P, V, intervals, points, query, r, samples, table, vertices

GUIDE = G.Guide(1.0, 2.0, 40.0, 60.0)
_U = GUIDE.unit


@query("frame_pca", f"WITH {P}, c AS (SELECT label, count(*) AS n, avg(x) AS ox, avg(y) AS oy, quantile_cont(z, 0.5) AS oz, var_samp(x) AS xx, covar_samp(x, y) AS xy, var_samp(y) AS yy FROM p GROUP BY label) SELECT label, n, round(ox, 5) AS ox, round(oy, 5) AS oy, round(oz, 5) AS oz, round(0.5 * atan2(2 * xy, xx - yy), 5) AS angle FROM c")
def frame_pca(spark, d):
    a = frames.pca_axes(points(spark, d), "label")
    return a.select("label", "n", *(r(c).alias(c) for c in ("ox", "oy", "oz", "angle")))


@query("guide_projection", f"WITH {V} SELECT line_id, seq, round((x - 1) * {_U[0]!r} + (y - 2) * {_U[1]!r}, 5) AS station, round((y - 2) * {_U[0]!r} - (x - 1) * {_U[1]!r}, 5) AS \"offset\" FROM v")
def guide_projection(spark, d):
    return frames.to_guide(vertices(spark, d), GUIDE).select("line_id", "seq", r("station").alias("station"), r("offset").alias("offset"))


@query("local_round_trip", f"WITH {V} SELECT line_id, seq, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM v")
def local_round_trip(spark, d):
    frame = G.Frame(25.0, 30.0, 5.0, 0.6, 0.8)
    back = frames.to_world(frames.to_local(vertices(spark, d), frame), frame)
    return back.select("line_id", "seq", *(r(c).alias(c) for c in "xyz"))


@query("affine_pixels", f"WITH {V} SELECT line_id, seq, floor((x - 10) / 0.05)::BIGINT AS col, floor((y - 200) / -0.05)::BIGINT AS row FROM v")
def affine_pixels(spark, d):
    col, row = G.Affine(0.05, 0.0, 10.0, 0.0, -0.05, 200.0).inverse().apply(F.col("x"), F.col("y"))
    # The inverse matrix rounds otherwise than a division; places on a pixel's edge are moved inside by a billionth first.
    return vertices(spark, d).select("line_id", "seq", F.floor((F.col("x") - 10) / 0.05).alias("col"), F.floor((F.col("y") - 200) / -0.05).alias("row"), col.alias("_c"), row.alias("_r")).filter((F.abs(F.col("_c") - F.col("col") - 0.5) < 0.5001) & (F.abs(F.col("_r") - F.col("row") - 0.5) < 0.5001)).drop("_c", "_r")


@query("arc_length", f"WITH {V}, d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS g FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, seq, round(sum(g) OVER (PARTITION BY line_id ORDER BY seq), 5) AS s FROM d")
def arc_length(spark, d):
    return lines.arc_length(vertices(spark, d), dims=("x", "y", "z")).select("line_id", "seq", r("s").alias("s"))


@query("line_summary", f"WITH {V}, d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS g FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, count(*) AS n, round(sum(g), 5) AS length, round(atan2(max_by(y, seq) - min_by(y, seq), max_by(x, seq) - min_by(x, seq)), 5) AS heading, min(x) AS x_min, max(x) AS x_max FROM d GROUP BY line_id")
def line_summary(spark, d):
    return lines.summary(vertices(spark, d)).select("line_id", "n", r("length").alias("length"), r("heading").alias("heading"), "x_min", "x_max")


_SEG = "g AS (SELECT line_id, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_, z FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)), h AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS l FROM g WHERE bx IS NOT NULL), a AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM h WHERE l > 0), t AS (SELECT line_id, max(s0 + l) AS len FROM a GROUP BY line_id)"


@query("densify", f"WITH {V}, {_SEG}, n AS (SELECT line_id, len, greatest(2, ceil(len / 20)::INT + 1) AS many FROM t), k AS (SELECT line_id, k, len, k * len / (many - 1) AS station FROM (SELECT *, unnest(range(many)) AS k FROM n)), m AS (SELECT k.line_id, k.k, k.station, a.*, row_number() OVER (PARTITION BY k.line_id, k.k ORDER BY a.s0 DESC) AS rn FROM k JOIN a ON a.line_id = k.line_id AND a.s0 <= least(k.station, k.len)) SELECT line_id, k::INT AS k, station, ax + (station - s0) / l * (bx - ax) AS x, ay + (station - s0) / l * (by_ - ay) AS y FROM m WHERE rn = 1")
def densify(spark, d):
    return lines.densify(vertices(spark, d), 20.0).select("line_id", "k", "station", "x", "y")


@query("turn_angles", f"WITH {V}, w AS (SELECT *, x - lag(x) OVER o AS a, y - lag(y) OVER o AS b, lead(x) OVER o - x AS c, lead(y) OVER o - y AS e FROM v WINDOW o AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, count(*) AS n, round(max(degrees(acos(least(1, greatest(-1, (a * c + b * e) / (sqrt(a * a + b * b) * sqrt(c * c + e * e))))))), 4) AS sharpest FROM w WHERE a IS NOT NULL AND c IS NOT NULL AND sqrt(a * a + b * b) * sqrt(c * c + e * e) > 0 GROUP BY line_id")
def turn_angles(spark, d):
    from ..operators.sequences import turn_angles as turns

    v = turns(vertices(spark, d), ["line_id"], "seq")
    from pyspark.sql import Window

    w = Window.partitionBy("line_id").orderBy("seq")
    moved = (F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))) > 0
    return v.withColumn("_m", moved).filter("_m").groupBy("line_id").agg(F.count("*").alias("n"), r(F.max("turn"), 4).alias("sharpest"))


@query("roi_filter", f"WITH {P} SELECT id, round(x, 5) AS x, round(y, 5) AS y FROM p WHERE x >= -10 AND x <= 10 AND y >= -5")
def roi_filter(spark, d):
    return filters.inside(points(spark, d), x_min=-10.0, x_max=10.0, y_min=-5.0, y_max=None).select("id", r("x").alias("x"), r("y").alias("y"))


@query("oriented_roi", f"WITH {P} SELECT id FROM p WHERE x * 0.6 + y * 0.8 BETWEEN -10 AND 10 AND y * 0.6 - x * 0.8 BETWEEN -8 AND 8 AND z BETWEEN -20 AND 20")
def oriented_roi(spark, d):
    return filters.inside_oriented(points(spark, d), G.Frame(0, 0, 0, 0.6, 0.8), (-10, 10), (-8, 8), (-20, 20)).select("id")


@query("height_filter", f"WITH {P} SELECT id FROM p WHERE z >= (SELECT quantile_cont(z, 0.65) FROM p)")
def height_filter(spark, d):
    return filters.highest(points(spark, d), 0.35).select("id")


@query("ground_height", f"WITH {P}, g AS (SELECT floor(x / 8)::BIGINT AS gx, floor(y / 8)::BIGINT AS gy, quantile_cont(z, 0.1) AS ground FROM p GROUP BY 1, 2) SELECT id, round(z - ground, 5) AS height FROM p JOIN g ON floor(x / 8)::BIGINT = gx AND floor(y / 8)::BIGINT = gy WHERE z - ground BETWEEN 0.5 AND 25")
def ground_height(spark, d):
    return filters.above_ground(points(spark, d), 8.0, 0.5, 25.0).select("id", r("height").alias("height"))


@query("slice_tops", f"WITH {P}, q AS (SELECT *, count(*) OVER w AS n, quantile_cont(z, 0.55) OVER w AS a, quantile_cont(z, 0.45) OVER w AS b, quantile_cont(z, 0.35) OVER w AS c FROM p WINDOW w AS (PARTITION BY label)), k AS (SELECT *, sum((z >= a)::INT) OVER w AS ka, sum((z >= b)::INT) OVER w AS kb, sum((z >= c)::INT) OVER w AS kc FROM q WINDOW w AS (PARTITION BY label)) SELECT id, label FROM k WHERE n < 8 OR coalesce(z >= CASE WHEN ka >= greatest(12, n // 2) THEN a WHEN kb >= greatest(12, n // 2) THEN b WHEN kc >= greatest(12, n // 2) THEN c END, true)")
def slice_tops(spark, d):
    return filters.slice_tops(points(spark, d), "label").select("id", "label")


@query("mad_outliers", f"WITH {V}, m AS (SELECT *, median(x) OVER w AS mx, median(y) OVER w AS my, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY line_id)), e AS (SELECT *, median(abs(x - mx)) OVER w AS dx, median(abs(y - my)) OVER w AS dy FROM m WINDOW w AS (PARTITION BY line_id)), f AS (SELECT *, abs(x - mx) <= 4 * (dx + 1e-6) AND abs(y - my) <= 4 * (dy + 1e-6) AS near FROM e), k AS (SELECT *, sum(near::INT) OVER (PARTITION BY line_id) AS kept FROM f) SELECT line_id, seq FROM k WHERE near OR n < 5 OR kept < 4")
def mad_outliers(spark, d):
    return filters.without_outliers(vertices(spark, d), ["line_id"], ("x", "y")).select("line_id", "seq")


@query("exclusion_windows", f"WITH {P} SELECT id FROM p WHERE NOT (x BETWEEN -6 AND 6 AND y BETWEEN -3 AND 9) AND NOT (x BETWEEN 9 AND 31 AND y BETWEEN -21 AND 1)")
def exclusion_windows(spark, d):
    return filters.outside_windows(points(spark, d).withColumnsRenamed({"x": "s", "y": "t"}), [(-5, 5, -2, 8), (10, 30, -20, 0)], 1.0).select("id")


@query("corridor_filter", f"WITH {P}, q AS (SELECT *, quantile_cont(y, 0.02) OVER (PARTITION BY label) AS a, quantile_cont(y, 0.98) OVER (PARTITION BY label) AS b FROM p) SELECT id FROM q WHERE y BETWEEN a - 0.5 AND b + 0.5")
def corridor_filter(spark, d):
    return filters.corridor(points(spark, d).withColumnRenamed("y", "t"), ["label"], 0.5).select("id")


_CS = "c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 97)::DOUBLE AS y FROM customer), s AS (SELECT s_suppkey AS sid, s_acctbal / 100 AS tx, (s_suppkey % 89)::DOUBLE AS ty FROM supplier)"


def _near(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_acctbal") / 100).alias("tx"), (F.col("s_suppkey") % 89).cast("double").alias("ty"))
    return c, s


@query("nearest_within", f"WITH {_CS}, n AS (SELECT id, sid, sqrt(pow(x - tx, 2) + pow(y - ty, 2)) AS dist FROM c JOIN s ON abs(x - tx) <= 6 AND abs(y - ty) <= 6), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid) AS rn FROM n WHERE dist <= 6) SELECT id, sid, round(dist, 5) AS distance FROM k WHERE rn = 1")
def nearest_within(spark, d):
    c, s = _near(spark, d)
    return ranges.nearest(c, s, 6.0, "id", "sid").select("id", "sid", r("distance").alias("distance"))


@query("near_pairs", f"WITH {_CS} SELECT id, sid FROM c JOIN s ON sqrt(pow(x - tx, 2) + pow(y - ty, 2)) <= 4")
def near_pairs(spark, d):
    c, s = _near(spark, d)
    return ranges.near_points(c, s, 4.0).select("id", "sid")


@query("near_segments", f"WITH {_CS}, g AS (SELECT sid, tx AS ax, ty AS ay, tx + 3 AS bx, ty + 4 AS by_ FROM s), m AS (SELECT id, sid, x, y, ax, ay, bx, by_, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS u FROM c, g WHERE x BETWEEN ax - 3.001 AND bx + 3.001 AND y BETWEEN ay - 3.001 AND by_ + 3.001) SELECT id, sid, round(sqrt((x - ax - u * (bx - ax)) * (x - ax - u * (bx - ax)) + (y - ay - u * (by_ - ay)) * (y - ay - u * (by_ - ay))), 5) AS distance FROM m WHERE sqrt((x - ax - u * (bx - ax)) * (x - ax - u * (bx - ax)) + (y - ay - u * (by_ - ay)) * (y - ay - u * (by_ - ay))) <= 3")
def near_segments(spark, d):
    c, s = _near(spark, d)
    g = s.select("sid", F.col("tx").alias("ax"), F.col("ty").alias("ay"), (F.col("tx") + 3).alias("bx"), (F.col("ty") + 4).alias("by"))
    return ranges.near_segments(c, g, 3.0).select("id", "sid", r("distance").alias("distance"))


@query("segment_crossings", f"WITH {_CS}, a AS (SELECT id, x AS ax, y AS ay, x + 2 AS bx, y + 3 AS by_ FROM c), b AS (SELECT sid, tx AS cx, ty AS cy, tx + 6 AS dx, ty - 4 AS dy FROM s), m AS (SELECT id, sid, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS det, (cx - ax) * (dy - cy) - (cy - ay) * (dx - cx) AS u, (cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax) AS w FROM a, b) SELECT id, sid FROM m WHERE det <> 0 AND u / det BETWEEN 0 AND 1 AND w / det BETWEEN 0 AND 1")
def segment_crossings(spark, d):
    c, s = _near(spark, d)
    a = c.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 2).alias("bx"), (F.col("y") + 3).alias("by"))
    b = s.select("sid", F.col("tx").alias("cx"), F.col("ty").alias("cy"), (F.col("tx") + 6).alias("dx"), (F.col("ty") - 4).alias("dy"))
    return ranges.crossings(a, b, 8.0).select("id", "sid")


@query("interval_overlap_join", "WITH i AS (SELECT o_orderkey AS id, o_custkey AS track, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS low, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE + floor(o_totalprice / 10000) AS high FROM orders) SELECT a.id AS a_id, b.id AS b_id, greatest(0, least(a.high, b.high) - greatest(a.low, b.low)) AS overlap FROM i a JOIN i b ON a.track = b.track AND a.id < b.id AND a.low <= b.high AND b.low <= a.high")
def interval_overlap_join(spark, d):
    i = intervals(spark, d)
    a = i.select("track", F.col("id").alias("a_id"), F.col("low").alias("a0"), F.col("high").alias("a1"))
    b = i.select("track", F.col("id").alias("b_id"), F.col("low").alias("b0"), F.col("high").alias("b1"))
    return ranges.interval_join(a, b, ("a0", "b0"), ("a1", "b1"), 30.0, ["track"]).filter("a_id < b_id").select("a_id", "b_id", C.interval_overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("overlap"))


@query("interpolated_lookup", 'WITH k AS (SELECT user_id AS track, event_id::DOUBLE AS station, value AS "offset" FROM events), q AS (SELECT c_custkey AS id, c_custkey % 150 AS track, (c_custkey * 7 % 9973)::DOUBLE + 0.5 AS place FROM customer), a AS (SELECT q.*, k.station AS s0, k."offset" AS v0 FROM q ASOF LEFT JOIN k ON q.track = k.track AND q.place >= k.station), b AS (SELECT a.*, k.station AS s1, k."offset" AS v1 FROM a ASOF LEFT JOIN k ON a.track = k.track AND a.place <= k.station) SELECT id, (CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0 ELSE v0 + (place - s0) / (s1 - s0) * (v1 - v0) END) AS "offset" FROM b')
def interpolated_lookup(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 150).alias("track"), ((F.col("c_custkey") * 7 % 9973) + 0.5).alias("at"))
    return ranges.interpolate(q, samples(spark, d).select("track", "station", "offset"), "at", "station", "offset", ["track"], "clamp").select("id", "offset")


@query("nearest_band", "WITH e AS (SELECT event_id AS id, value FROM events) SELECT id, CASE WHEN abs(value - 10) <= 8 AND abs(value - 10) <= CASE WHEN abs(value - 40) <= 25 THEN abs(value - 40) ELSE 1e9 END THEN 'near' WHEN abs(value - 40) <= 25 THEN 'middle' WHEN abs(value - 120) <= 40 THEN 'far' END AS band_id FROM e")
def nearest_band(spark, d):
    e = samples(spark, d).select("id", "offset")
    return ranges.nearest_band(e, [("near", 10.0, 8.0), ("middle", 40.0, 25.0), ("far", 120.0, 40.0)], "offset").select("id", "band_id")


@query("even_sample", "WITH n AS (SELECT count(*) AS n FROM events), k AS (SELECT unnest(range(500)) AS k), p AS (SELECT floor(k * (n - 1) / 499.0)::BIGINT AS pos FROM k, n), e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) SELECT event_id AS id FROM e WHERE pos IN (SELECT pos FROM p)")
def even_sample(spark, d):
    return sampling.even(samples(spark, d).select("id"), "id", 500)


@query("stride_sample", "SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE k % 5 = 0")
def stride_sample(spark, d):
    return sampling.stride(samples(spark, d), ["track"], "id", 5).select("id")


@query("quotas", "WITH g AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation), x AS (SELECT *, n * 1000.0::DOUBLE / sum(n) OVER () AS e FROM g WHERE n > 0), f AS (SELECT *, floor(e) AS w FROM x), q AS (SELECT *, row_number() OVER (ORDER BY e - w DESC, k) AS rk, 1000 - sum(w) OVER () AS rest FROM f) SELECT k AS nation, n, least(greatest(1, w + CASE WHEN rk <= rest THEN 1 ELSE 0 END), n)::BIGINT AS quota FROM q")
def quotas(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return sampling.quotas(g, "nation", "n", 1000)


@query("top_per_group", "SELECT o_custkey AS track, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 6")
def top_per_group(spark, d):
    o = table(spark, d, "orders")
    return sampling.top(o, ["o_custkey"], F.col("o_totalprice"), "o_orderkey", 6).select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("id"))


@query("train_val_split", "SELECT event_id AS id, CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM events")
def train_val_split(spark, d):
    return sampling.every_nth_split(samples(spark, d).select("id"), "id", 5)


@query("bounds", f"WITH {V} SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, round(min(y), 5) AS y_min, round(max(y), 5) AS y_max FROM v")
def bounds(spark, d):
    return vertices(spark, d).agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), r(F.min("y")).alias("y_min"), r(F.max("y")).alias("y_max"))


@query("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).exceptAll(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()).distinct()


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return filters.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("orientation_axis", f"WITH {V}, g AS (SELECT line_id, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)), h AS (SELECT *, sqrt(dx * dx + dy * dy) AS l, atan2(dy, dx) AS a FROM g WHERE dx IS NOT NULL) SELECT line_id, round(0.5 * atan2(sum(l * sin(2 * a)), sum(l * cos(2 * a))), 4) AS angle FROM h WHERE l >= 0.5 GROUP BY line_id")
def orientation_axis(spark, d):
    g = ranges.segments_of(vertices(spark, d)).select("line_id", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    return aggregates.double_angle(g, ["line_id"]).select("line_id", r("angle", 4).alias("angle"))


@query("text_functions", "SELECT p_partkey AS id, lower(regexp_replace(trim(p_name), '[^A-Za-z0-9._-]+', '_', 'g')) AS safe, 'AUTO_' || lpad(p_size::VARCHAR, 3, '0') AS code, coalesce(nullif(trim(p_brand), ''), 'none') AS brand, regexp_replace(printf('%.6f', p_retailprice), '\\.?0+$', '') AS price FROM part")
def text_functions(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lower(C.file_safe(F.col("p_name"))).alias("safe"), C.numbered("AUTO_", F.col("p_size")).alias("code"), C.first_text(F.col("p_brand"), F.lit("none")).alias("brand"), C.trimmed(F.col("p_retailprice")).alias("price"))


@query("classes", "SELECT o_orderkey AS id, CASE WHEN r >= 2500 THEN 'straight_or_flat' WHEN r < 120 THEN 'sharp_or_noisy' WHEN r < 260 THEN 'tight_curve' WHEN r <= 520 THEN 'turnout_curve_range' ELSE 'large_radius_curve' END AS radius_class, round(1 / (1 + exp(-least(40, greatest(-40, (r - 300) / 50)))), 6) AS score FROM (SELECT o_orderkey, o_totalprice / 150 AS r FROM orders)")
def classes(spark, d):
    rad = F.col("o_totalprice") / 150
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.radius_class(rad).alias("radius_class"), r(C.sigmoid((rad - 300) / 50), 6).alias("score"))
