"""Queries: aggregates, ordered sequences, graphs, matching, curves, rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, curves, dynamic, filters, graph, raster
from ..operators import sequences as seq
from ..storage import stored
from .registry import I, S, V, intervals, points, query, r, samples, table, vertices


@query("lateral_profile", """
WITH b AS (SELECT event_type AS kind, floor(value / 4)::BIGINT AS bin, count(*) AS n FROM (SELECT c_mktsegment AS event_type, c_acctbal / 100 AS value FROM customer) GROUP BY 1, 2),
e AS (SELECT kind, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY kind),
f AS (SELECT kind, bin, coalesce(n, 0) AS n FROM e LEFT JOIN b USING (kind, bin)),
m AS (SELECT *, avg(n) OVER (PARTITION BY kind ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM f),
p AS (SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS c, greatest(0.2 * max(smooth) OVER (PARTITION BY kind), quantile_cont(smooth, 0.7) OVER (PARTITION BY kind)) AS t FROM m WINDOW w AS (PARTITION BY kind ORDER BY bin)),
k AS (SELECT * FROM p WHERE smooth > 0 AND smooth >= a AND smooth >= c AND smooth >= t)
SELECT x.kind, x.bin * 4.0::DOUBLE AS left_at, y.bin * 4.0::DOUBLE AS right_at, (y.bin - x.bin) * 4.0::DOUBLE AS gap, round(least(x.smooth, y.smooth), 5) AS score
FROM k x JOIN k y ON x.kind = y.kind AND (y.bin - x.bin) * 4 BETWEEN 8 AND 40""")
def lateral_profile(spark, d):
    """Histogram across the track, made dense, smoothed, its peaks, and the pairs of peaks a gauge apart."""
    e = table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") / 100).alias("value"))
    bins = aggregates.dense(aggregates.histogram(e, "value", 4.0, ["kind"]), ["kind"])
    smooth = bins.withColumn("smooth", seq.moving_average(F.col("n"), ["kind"], "bin", 2)).withColumn("at", F.col("bin") * 4.0)
    peaks = seq.local_maxima(smooth, ["kind"], "bin", "smooth")
    pairs = seq.peak_pairs(peaks, ["kind"], "at", "smooth", 8.0, 40.0)
    return pairs.select("kind", "left_at", "right_at", "gap", r("pair_score").alias("score"))


@query("histogram_percentile", f"WITH {S}, b AS (SELECT track, floor(\"offset\" / 5)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY bin) AS c, sum(n) OVER (PARTITION BY track) AS t FROM b) SELECT track, (min(bin) + 0.5::DOUBLE) * 5 AS value FROM c WHERE c >= t * 0.85::DOUBLE GROUP BY track")
def histogram_percentile(spark, d):
    return aggregates.histogram_percentile(aggregates.histogram(samples(spark, d), "offset", 5.0, ["track"]), ["track"], 0.85, 5.0)


@query("weighted_grid", "SELECT floor(event_id / 500.0)::BIGINT AS s_bin, floor(value / 20)::BIGINT AS t_bin, round(sum(value * 0.01), 4) AS weight, count(*) AS n FROM events GROUP BY 1, 2")
def weighted_grid(spark, d):
    g = aggregates.grid(samples(spark, d).withColumn("z", F.col("offset")), "station", "offset", 500.0, 20.0, F.col("offset") * 0.01)
    return g.select("s_bin", "t_bin", r("weight", 4).alias("weight"), "n")


@query("feature_spans", f"WITH {S} SELECT track, count(*) AS n, min(station) AS s_min, max(station) AS s_max, min(\"offset\") AS t_min, max(\"offset\") AS t_max, round(quantile_cont(\"offset\", 0.5), 5) AS t_median, round(CASE WHEN max(station) > min(station) THEN (max_by(\"offset\", station) - min_by(\"offset\", station)) / (max(station) - min(station)) ELSE 0 END, 8) AS slope FROM s GROUP BY track")
def feature_spans(spark, d):
    return aggregates.spans(samples(spark, d), ["track"]).select("track", "n", "s_min", "s_max", "t_min", "t_max", r("t_median").alias("t_median"), r("slope", 8).alias("slope"))


@query("line_fit", f"WITH {S}, f AS (SELECT track, count(*) AS n, coalesce(regr_slope(\"offset\", station), 0) AS slope, avg(station) AS mx, avg(\"offset\") AS my FROM s GROUP BY track) SELECT track, any_value(n) AS n, round(any_value(slope), 7) AS slope, round(any_value(my - slope * mx), 4) AS intercept, round(sqrt(avg(pow(\"offset\" - my - slope * (station - mx), 2))), 4) AS rms FROM s JOIN f USING (track) GROUP BY track")
def line_fit(spark, d):
    return aggregates.line_fit(samples(spark, d), ["track"]).select("track", "n", r("slope", 7).alias("slope"), r("intercept", 4).alias("intercept"), r("rms", 4).alias("rms"))


@query("trimmed_fit", f"WITH {S}, f AS (SELECT track, coalesce(regr_slope(\"offset\", station), 0) AS b, avg(station) AS mx, avg(\"offset\") AS my FROM s GROUP BY track), e AS (SELECT s.*, abs(\"offset\" - my - b * (station - mx)) AS res FROM s JOIN f USING (track)), q AS (SELECT *, quantile_cont(res, 0.8) OVER (PARTITION BY track) AS cut FROM e) SELECT track, count(*) AS n, round(coalesce(regr_slope(\"offset\", station), 0), 6) AS slope FROM q WHERE res <= cut GROUP BY track")
def trimmed_fit(spark, d):
    return aggregates.trimmed_fit(samples(spark, d), ["track"], 0.2).select("track", "n", r("slope", 6).alias("slope"))


def _robust_sql(rounds: int) -> str:
    out, last = [S, 'r0 AS (SELECT *, "offset" AS y, station AS x, true AS inn, count(*) OVER (PARTITION BY track) AS n0 FROM s)'], "r0"
    for k in range(1, rounds + 1):
        out += [
            f"f{k} AS (SELECT track, avg(x) AS mx, avg(y) AS my, coalesce(regr_slope(y, x), 0) AS b, count(*) AS had FROM {last} WHERE inn GROUP BY track)",
            f"e{k} AS (SELECT r.*, y - my - b * (x - mx) AS res, had FROM {last} r JOIN f{k} USING (track))",
            f"c{k} AS (SELECT track, quantile_cont(res, 0.5) AS c FROM e{k} WHERE inn GROUP BY track)",
            f"d{k} AS (SELECT track, quantile_cont(abs(res - c), 0.5) AS d FROM e{k} JOIN c{k} USING (track) WHERE inn GROUP BY track)",
            f"k{k} AS (SELECT e.*, inn AND abs(res - c) <= greatest(6, least(60, 3 * 1.4826 * d)) AS nxt FROM e{k} e JOIN c{k} USING (track) JOIN d{k} USING (track))",
            f"m{k} AS (SELECT *, sum(nxt::INT) OVER (PARTITION BY track) AS kk FROM k{k})",
            f"r{k} AS (SELECT id, track, station, \"offset\", y, x, CASE WHEN had >= 8 AND kk >= least(8, n0) THEN nxt ELSE inn END AS inn, n0 FROM m{k})",
        ]
        last = f"r{k}"
    return "WITH " + ", ".join(out) + f" SELECT track, round(coalesce(regr_slope(y, x), 0), 6) AS slope, count(*) AS n_inliers FROM {last} WHERE inn GROUP BY track"


@query("robust_fit", _robust_sql(3))
def robust_fit(spark, d):
    return aggregates.robust_fit(samples(spark, d), ["track"], 3, floor=6.0, ceiling=60.0).select("track", r("slope", 6).alias("slope"), "n_inliers")


@query("weighted_bins", f"WITH {S}, b AS (SELECT *, greatest(\"offset\" / 500, 0.05) AS w, round_even((station - min(station) OVER (PARTITION BY track)) / 400, 0)::BIGINT AS bin FROM s) SELECT track, round(sum(w * station) / sum(w), 4) AS station, round(sum(w * \"offset\") / sum(w), 4) AS \"offset\", count(*) AS n FROM b GROUP BY track, bin")
def weighted_bins(spark, d):
    s = samples(spark, d).withColumn("confidence", F.col("offset") / 500)
    return aggregates.weighted_bins(s, ["track"], 400.0).select("track", r("station", 4).alias("station"), r("offset", 4).alias("offset"), "n")


@query("confusion", "WITH t AS (SELECT quality = 1 AS t, n_chars >= 800 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT sum((t AND g)::INT)::BIGINT AS tp, sum((NOT t AND g)::INT)::BIGINT AS fp, sum((t AND NOT g)::INT)::BIGINT AS fn, sum((NOT t AND NOT g)::INT)::BIGINT AS tn FROM t) SELECT *, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, round(tp / greatest(tp + fp + fn, 1), 6) AS iou FROM c")
def confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    c = aggregates.confusion(rows, F.col("quality") == 1, F.col("n_chars") >= 800)
    return c.select("tp", "fp", "fn", "tn", *(r(x, 6).alias(x) for x in ("precision", "recall", "f1", "iou")))


@query("best_threshold", "WITH t AS (SELECT quality = 1 AS t, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)), h AS (SELECT unnest([200.0, 500.0, 1000.0, 2000.0]::DOUBLE[]) AS threshold), c AS (SELECT threshold, sum((t AND s >= threshold)::INT) AS tp, sum((NOT t AND s >= threshold)::INT) AS fp, sum((t AND s < threshold)::INT) AS fn FROM t, h GROUP BY threshold) SELECT threshold, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c ORDER BY 2 * tp / greatest(2 * tp + fp + fn, 1) DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double")), "doc_id").withColumn("truth", F.col("quality") == 1)
    return aggregates.best_threshold(rows, "truth", "n_chars", [200.0, 500.0, 1000.0, 2000.0]).select("threshold", r("f1", 6).alias("f1"))


@query("rank_quantiles", f"WITH {S}, a AS (SELECT track, list_sort(list(\"offset\")) AS l, count(*) AS n FROM s GROUP BY track) SELECT track, l[(round_even((n - 1) * 0.5::DOUBLE, 0) + 1)::INT] AS p50, l[(round_even((n - 1) * 0.9::DOUBLE, 0) + 1)::INT] AS p90, l[least(floor(n * 0.4::DOUBLE)::INT + 1, n::INT)] AS i40 FROM a")
def rank_quantiles(spark, d):
    return samples(spark, d).groupBy("track").agg(aggregates.rank_quantile(F.col("offset"), 0.5).alias("p50"), aggregates.rank_quantile(F.col("offset"), 0.9).alias("p90"), aggregates.index_quantile(F.col("offset"), 0.4).alias("i40"))


@query("roughness", f"WITH {S}, g AS (SELECT *, abs(\"offset\" - lag(\"offset\") OVER (PARTITION BY track ORDER BY station)) AS g FROM s) SELECT track, round(avg(\"offset\"), 4) AS mean, round(stddev_pop(\"offset\"), 4) AS spread, round(quantile_cont(g, 0.95), 4) AS step_p95 FROM g GROUP BY track")
def roughness(spark, d):
    return aggregates.roughness(samples(spark, d), ["track"], "station", "offset").select("track", *(r(c, 4).alias(c) for c in ("mean", "spread", "step_p95")))


@query("displacement", """WITH b AS (SELECT user_id AS track, event_id::DOUBLE AS station, value AS v FROM events), a AS (SELECT track, station, v FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY station) AS k FROM b) WHERE k % 2 = 1),
e AS (SELECT track, greatest(min(a.station), any_value(b0)) AS lo, least(max(a.station), any_value(b1)) AS hi FROM a JOIN (SELECT track, min(station) AS b0, max(station) AS b1 FROM b GROUP BY track) USING (track) GROUP BY track),
k AS (SELECT track, lo + 50.0::DOUBLE * unnest(range(floor((hi - lo) / 50)::INT + 1)) AS place FROM e),
p AS (SELECT k.*, a.station AS s0, a.v AS v0 FROM k ASOF JOIN a ON k.track = a.track AND k.place >= a.station), q AS (SELECT p.*, a.station AS s1, a.v AS v1 FROM p ASOF JOIN a ON p.track = a.track AND p.place <= a.station),
u AS (SELECT q.*, b.station AS t0, b.v AS w0 FROM q ASOF JOIN b ON q.track = b.track AND q.place >= b.station), w AS (SELECT u.*, b.station AS t1, b.v AS w1 FROM u ASOF JOIN b ON u.track = b.track AND u.place <= b.station),
x AS (SELECT track, abs(CASE WHEN s1 = s0 THEN v0 ELSE v0 + (place - s0) / (s1 - s0) * (v1 - v0) END - CASE WHEN t1 = t0 THEN w0 ELSE w0 + (place - t0) / (t1 - t0) * (w1 - w0) END) AS d FROM w)
SELECT track, round(avg(d), 4) AS mean, round(max(d), 4) AS most FROM x GROUP BY track""")
def displacement(spark, d):
    b = samples(spark, d).select("track", "station", "offset")
    a = b.withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy("station"))).filter("k % 2 = 1").drop("k")
    return aggregates.displacement(a, b, ["track"], 50.0).select("track", r("mean", 4).alias("mean"), r("most", 4).alias("most"))


@query("moving_averages", f"WITH {S} SELECT id, round(avg(\"offset\") OVER (PARTITION BY track ORDER BY station ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS mean, round(coalesce(0.25 * lag(\"offset\") OVER w + 0.5 * \"offset\" + 0.25 * lead(\"offset\") OVER w, \"offset\"), 5) AS binomial, round(sum(\"offset\") OVER (PARTITION BY track ORDER BY station ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 5) AS same FROM s WINDOW w AS (PARTITION BY track ORDER BY station)")
def moving_averages(spark, d):
    k, v = ["track"], F.col("offset")
    return samples(spark, d).select("id", r(seq.moving_average(v, k, "station", 3)).alias("mean"), r(seq.binomial(v, k, "station")).alias("binomial"), r(seq.moving_sum_same(v, k, "station", 5)).alias("same"))


@query("rolling_medians", f"WITH {S} SELECT id, round(quantile_cont(\"offset\", 0.5) OVER (PARTITION BY track ORDER BY station ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 5) AS by_rows, round(quantile_cont(\"offset\", 0.5) OVER (PARTITION BY track ORDER BY station RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING), 5) AS by_station FROM s")
def rolling_medians(spark, d):
    k, v = ["track"], F.col("offset")
    return samples(spark, d).select("id", r(seq.rolling_median(v, k, "station", 4)).alias("by_rows"), r(seq.station_median(v, k, "station", 300)).alias("by_station"))


@query("despike", f"""WITH {S}, a AS (SELECT *, quantile_cont("offset", 0.5) OVER (PARTITION BY track ORDER BY station ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM s),
b AS (SELECT *, "offset" - m AS res FROM a), c AS (SELECT *, quantile_cont(res, 0.5) OVER (PARTITION BY track) AS c FROM b), e AS (SELECT *, quantile_cont(abs(res - c), 0.5) OVER (PARTITION BY track) AS dd FROM c),
f AS (SELECT *, abs(res) > greatest(0.18, 6 * 1.4826 * dd) AS o1, CASE WHEN abs(res) > greatest(0.18, 6 * 1.4826 * dd) THEN m ELSE "offset" END AS v1 FROM e),
g AS (SELECT *, quantile_cont(v1, 0.5) OVER (PARTITION BY track ORDER BY station ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m2 FROM f), h AS (SELECT *, v1 - m2 AS r2 FROM g),
i AS (SELECT *, quantile_cont(r2, 0.5) OVER (PARTITION BY track) AS c2 FROM h), j AS (SELECT *, quantile_cont(abs(r2 - c2), 0.5) OVER (PARTITION BY track) AS d2 FROM i)
SELECT id, o1 OR abs(r2) > greatest(0.45, 8 * 1.4826 * d2) AS outlier, round(CASE WHEN abs(r2) > greatest(0.45, 8 * 1.4826 * d2) THEN m2 ELSE v1 END, 5) AS clean FROM j""")
def despike(spark, d):
    return seq.despiked(samples(spark, d), ["track"], "station", "offset", 2, 7).select("id", "outlier", r("clean").alias("clean"))


@query("islands", f"WITH {S}, c AS (SELECT *, CASE WHEN station - lag(station) OVER w > 120 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY track ORDER BY station)), g AS (SELECT *, sum(cut) OVER (PARTITION BY track ORDER BY station) AS g FROM c), t AS (SELECT track, g, min(station) AS start, max(station) AS \"end\", count(*) AS n FROM g GROUP BY track, g), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY \"end\" - start DESC, n DESC, start) AS k FROM t) SELECT track, start, \"end\", \"end\" - start AS span, n FROM k WHERE k = 1")
def islands(spark, d):
    return seq.largest_island(samples(spark, d), ["track"], "station", 120.0)


@query("merged_intervals", f"WITH {I}, c AS (SELECT *, CASE WHEN max(high) OVER w IS NULL OR low > max(high) OVER w + 15 THEN 1 ELSE 0 END AS cut FROM i WINDOW w AS (PARTITION BY track ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(cut) OVER (PARTITION BY track ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS g FROM c) SELECT track, min(low) AS low, max(high) AS high, count(*) AS n FROM g GROUP BY track, g")
def merged_intervals(spark, d):
    return seq.merged_intervals(intervals(spark, d), ["track"], "low", "high", 15.0).select("track", "low", "high", "n")


@query("interval_gaps", f"WITH {I}, c AS (SELECT track, max(high) OVER (PARTITION BY track ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS gap_start, lead(low) OVER (PARTITION BY track ORDER BY low, high) AS gap_end FROM i) SELECT * FROM c WHERE gap_end > gap_start")
def interval_gaps(spark, d):
    return seq.gaps(intervals(spark, d), ["track"], "low", "high")


@query("unsupported_runs", f"WITH {S}, m AS (SELECT *, \"offset\" <= 60 AS ok FROM s), c AS (SELECT *, CASE WHEN ok = lag(ok) OVER w THEN 0 ELSE 1 END AS cut FROM m WINDOW w AS (PARTITION BY track ORDER BY station)), g AS (SELECT *, sum(cut) OVER (PARTITION BY track ORDER BY station) AS g FROM c), t AS (SELECT track, g, any_value(ok) AS ok, count(*) AS n FROM g GROUP BY track, g) SELECT track, coalesce(max(n) FILTER (NOT ok), 0) * 5.0::DOUBLE AS max_unsupported FROM t GROUP BY track")
def unsupported_runs(spark, d):
    return seq.longest_unsupported(samples(spark, d), ["track"], "station", F.col("offset") <= 60, 5.0)


@query("filled_values", f"WITH {S}, m AS (SELECT *, CASE WHEN id % 3 <> 0 THEN \"offset\" END AS v FROM s), k AS (SELECT * FROM m WHERE v IS NOT NULL), a AS (SELECT m.id, m.track, m.station, k.station AS s0, k.v AS v0 FROM m ASOF LEFT JOIN k ON m.track = k.track AND m.station >= k.station), b AS (SELECT a.*, k.station AS s1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.track = k.track AND a.station <= k.station) SELECT id, (CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s1 = s0 THEN v0 ELSE v0 + (station - s0) / (s1 - s0) * (v1 - v0) END) AS v FROM b")
def filled_values(spark, d):
    s = samples(spark, d).withColumn("v", F.when(F.col("id") % 3 != 0, F.col("offset")))
    return s.select("id", seq.filled(F.col("v"), ["track"], "station").alias("v"))


@query("monotone", f"WITH {S} SELECT id, max(\"offset\") OVER (PARTITION BY track ORDER BY station) AS rising, min(\"offset\") OVER (PARTITION BY track ORDER BY station) AS falling FROM s")
def monotone(spark, d):
    k = ["track"]
    return samples(spark, d).select("id", seq.monotone(F.col("offset"), k, "station", F.lit(True)).alias("rising"), seq.monotone(F.col("offset"), k, "station", F.lit(False)).alias("falling"))


@query("slopes", f"WITH {S}, g AS (SELECT *, (lead(\"offset\") OVER w - \"offset\") / (lead(station) OVER w - station) AS slope FROM s WINDOW w AS (PARTITION BY track ORDER BY station)) SELECT id, round(slope, 6) AS slope FROM g")
def slopes(spark, d):
    return seq.slopes(samples(spark, d), ["track"], "station", "offset").select("id", r("slope", 6).alias("slope"))


@query("adjacent_pairs", f"WITH {V}, g AS (SELECT line_id, x, lead(x) OVER (PARTITION BY line_id ORDER BY x, seq) AS nx FROM v) SELECT line_id, x AS left_at, nx AS right_at FROM g WHERE nx - x BETWEEN 3 AND 9")
def adjacent_pairs(spark, d):
    w = Window.partitionBy("line_id").orderBy("x", "seq")
    v = vertices(spark, d).withColumn("right_at", F.lead("x").over(w))
    return v.filter((F.col("right_at") - F.col("x")).between(3, 9)).select("line_id", F.col("x").alias("left_at"), "right_at")


@query("components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 400 AS a, 400 + l_partkey % 2000 AS b FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09),
n AS (SELECT a AS node FROM e UNION SELECT b FROM e), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, seen) AS (SELECT node, node FROM n UNION SELECT w.node, u.b FROM w JOIN u ON w.seen = u.a)
SELECT node, min(seen) AS component FROM w GROUP BY node""")
def components(spark, d):
    t = table(spark, d, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09")
    return graph.components(t.select((F.col("l_orderkey") % 400).alias("a"), (400 + F.col("l_partkey") % 2000).alias("b")))


@query("components_all")
def components_all(spark, d):
    """Every line item as an edge between its order (even nodes) and its part (odd nodes); recursive SQL cannot do it at this size."""
    t = table(spark, d, "lineitem").filter("l_orderkey is not null and l_partkey is not null")
    return graph.components(t.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


@query("occupancy", "WITH l AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) SELECT floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, least(count(*), 65535)::BIGINT AS n FROM l GROUP BY 1, 2")
def occupancy(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return aggregates.occupancy(t, 2.0).select("cx", "cy", F.col("n").cast("long"))


@query("grid_components")
def grid_components(spark, d):
    t = table(spark, d, "customer").select((F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    return graph.grid_components(aggregates.occupancy(t, 4.0), 1).groupBy("component").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


@query("endpoint_nodes")
def endpoint_nodes(spark, d):
    ends = table(spark, d, "customer").select(F.col("c_custkey").alias("end_id"), (F.col("c_acctbal") / 20).alias("x"), (F.col("c_custkey") % 97 * 5).cast("double").alias("y"), (F.col("c_nationkey") == 3).alias("accepted"))
    return graph.degrees(graph.endpoint_clusters(ends, 2.0))


@query("disjoint_pairs")
def disjoint_pairs(spark, d):
    v = vertices(spark, d).select("line_id", "x", (F.col("y") / 100).alias("score"))
    return dynamic.best_disjoint_pairs(v, ["line_id"], 2.0, 20.0, 8.0).select("line_id", "left", "right", r("confidence").alias("confidence"))


@query("gauge_pairs")
def gauge_pairs(spark, d):
    v = vertices(spark, d).select("line_id", F.col("x").alias("offset"), (F.col("y") / 100).alias("score"))
    return dynamic.gauge_pairs(v, ["line_id"], 8.0, 4.0, 3)


@query("linked_tracks")
def linked_tracks(spark, d):
    s = samples(spark, d).withColumn("station", F.floor(F.col("station") / 50) * 50).select((F.col("track") % 10).alias("area"), "station", F.col("offset").alias("center"), (1 / (1 + F.col("offset"))).alias("score"))
    return dynamic.linked_tracks(s, ["area"], 150.0, 6.0, 0.05, 4, 150.0)


@query("traced_path")
def traced_path(spark, d):
    s = samples(spark, d).select((F.col("track") % 10).alias("area"), (F.floor(F.col("station") / 50) * 50).alias("station"), "offset", (1 / (1 + F.abs(F.col("offset") - 40) / 20)).alias("score"))
    return dynamic.traced(s, ["area"], weight=0.02)


@query("smoothed_profile")
def smoothed_profile(spark, d):
    return dynamic.smoothed(samples(spark, d), ["track"], "station", "offset", 11, 2).select("id", r("smooth", 4).alias("smooth"))


@query("best_chain")
def best_chain(spark, d):
    i = intervals(spark, d).select("track", F.col("id").alias("segment_id"), F.col("low").alias("s0"), F.col("high").alias("s1"))
    return dynamic.best_chain(i, ["track"])


_ENDS = "c AS (SELECT o_orderkey AS line_id, 0.0::DOUBLE AS s0, 10 + o_totalprice / 10000 AS s1, 1.0::DOUBLE AS t0, 1 + (o_custkey % 7)::DOUBLE AS t1 FROM orders), k AS (SELECT *, unnest(range(9)) AS k FROM c)"


def _ends(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("line_id"), F.lit(0.0).alias("s0"), (10 + F.col("o_totalprice") / 10000).alias("s1"), F.lit(1.0).alias("t0"), (1 + F.col("o_custkey") % 7).cast("double").alias("t1"), F.lit(0.1).alias("m0"), F.lit(0.0).alias("m1"))


@query("hermite_curve", f"WITH {_ENDS} SELECT line_id, k::INT AS k, (s0 + k / 8 * (s1 - s0)) AS station, ((2 * pow(k / 8, 3) - 3 * pow(k / 8, 2) + 1) * t0 + (pow(k / 8, 3) - 2 * pow(k / 8, 2) + k / 8) * (s1 - s0) * 0.1 + (3 * pow(k / 8, 2) - 2 * pow(k / 8, 3)) * t1) AS \"offset\" FROM k")
def hermite_curve(spark, d):
    return curves.hermite(_ends(spark, d), 8).select("line_id", "k", "station", "offset")


@query("smoothstep_curve", f"WITH {_ENDS} SELECT line_id, k::INT AS k, round(t0 + (t1 - t0) * (pow(k / 8, 2) * (3 - 2 * k / 8)), 5) AS \"offset\" FROM k")
def smoothstep_curve(spark, d):
    return curves.eased(_ends(spark, d), 8).select("line_id", "k", r("offset").alias("offset"))


@query("profile_curve")
def profile_curve(spark, d):
    return curves.curve_straight_curve(_ends(spark, d), 8).select("line_id", "k", r("offset").alias("offset"))


@query("tile_mosaic", "WITH t AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, l_discount * 10 AS value FROM lineitem) SELECT row, col, round(avg(value), 6) AS mean, count(*) AS n FROM t GROUP BY 1, 2")
def tile_mosaic(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"), (F.col("l_discount") * 10).alias("value"))
    return raster.mosaic(p).select("row", "col", r("mean", 6).alias("mean"), "n")


@query("neighbourhood", "WITH p AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, max(l_discount) AS value FROM lineitem GROUP BY 1, 2), q AS (SELECT c_custkey AS point_id, c_custkey % 64 AS row, c_custkey * 7 % 64 AS col FROM customer) SELECT point_id, max(value) AS most, round(avg(value), 6) AS mean, round(avg((value >= 0.08)::INT), 6) AS share FROM q LEFT JOIN p ON p.row BETWEEN q.row - 2 AND q.row + 2 AND p.col BETWEEN q.col - 2 AND q.col + 2 GROUP BY point_id")
def neighbourhood(spark, d):
    p = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.max("l_discount").alias("value"))
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 64).alias("row"), (F.col("c_custkey") * 7 % 64).alias("col"))
    return raster.around(q, p, 2, 0.08).select("point_id", "most", r("mean", 6).alias("mean"), r("share", 6).alias("share"))


@query("row_runs", "WITH p AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, max(l_discount) AS value FROM lineitem WHERE l_quantity < 5 GROUP BY 1, 2), o AS (SELECT *, CASE WHEN col - lag(col) OVER (PARTITION BY row ORDER BY col) > 1 THEN 1 ELSE 0 END AS cut FROM p WHERE value >= 0.05), g AS (SELECT *, sum(cut) OVER (PARTITION BY row ORDER BY col) AS g FROM o) SELECT row, round(sum(col * value) / sum(value), 5) AS x, round(avg(value), 5) AS score, count(*) AS width FROM g GROUP BY row, g")
def row_runs(spark, d):
    p = table(spark, d, "lineitem").filter("l_quantity < 5").groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.max("l_discount").alias("value"))
    return raster.row_peaks(p, [], 0.05).select("row", r("x").alias("x"), r("score").alias("score"), "width")


@query("row_runs_all", "WITH p AS (SELECT l_orderkey AS row, l_linenumber AS col, max(l_discount) AS value FROM lineitem GROUP BY 1, 2), o AS (SELECT *, CASE WHEN col - lag(col) OVER (PARTITION BY row ORDER BY col) > 1 THEN 1 ELSE 0 END AS cut FROM p WHERE value >= 0.05), g AS (SELECT *, sum(cut) OVER (PARTITION BY row ORDER BY col) AS g FROM o) SELECT row, round(sum(col * value) / sum(value), 5) AS x, round(avg(value), 5) AS score, count(*) AS width FROM g GROUP BY row, g")
def row_runs_all(spark, d):
    """Every line item as a pixel: a row for each order, its lines side by side."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_discount").alias("value"))
    return raster.row_peaks(p, [], 0.05).select("row", r("x").alias("x"), r("score").alias("score"), "width")


@query("rail_fusion")
def rail_fusion(spark, d):
    s = samples(spark, d).select("track", "station", F.when(F.col("id") % 5 != 0, F.col("offset")).alias("left_z"), F.when(F.col("id") % 7 != 0, F.col("offset") + F.col("id") % 3 * 0.2).alias("right_z"))
    return curves.fused_z(s, ["track"], "station").select("track", "station", r("z").alias("z"), "how")


@query("gap_bridges")
def gap_bridges(spark, d):
    i = intervals(spark, d).select("track", F.col("low").alias("s0"), F.col("high").alias("s1"), F.lit(0.0).alias("t0"), F.lit(0.0).alias("t1"), (F.col("id") % 10 / 10).alias("evidence"))
    return curves.bridges(i, ["track"], 0.65, 20.0, 60.0)


@query("suppressed_peaks")
def suppressed_peaks(spark, d):
    return seq.suppressed(vertices(spark, d).select("line_id", "x", "y"), ["line_id"], "x", "y", 6.0)


@query("station_ground", "WITH s AS (SELECT floor(event_id / 64.0)::BIGINT AS b, value AS z FROM events), q AS (SELECT quantile_cont(value, 0.2) AS q FROM events) SELECT b AS station_bin, round(CASE WHEN count(*) < 8 THEN any_value(q) ELSE quantile_cont(z, 0.2) END, 5) AS ground FROM s, q GROUP BY b")
def station_ground(spark, d):
    s = samples(spark, d).withColumn("z", F.col("offset"))
    return filters.station_ground(s, 64.0).select("station_bin", r("ground").alias("ground"))


@query("offset_score")
def offset_score(spark, d):
    return aggregates.offset_score(points(spark, d), [k * 0.1 for k in range(-5, 6)], 2.0)


@query("centreline")
def centreline(spark, d):
    """Line items as one cloud per return flag: stations along the order key, rails by the parity of the line."""
    from .centreline import Config, detections

    t = table(spark, d, "lineitem")
    rail = F.when(F.col("l_linenumber") % 2 == 0, 0.75).otherwise(-0.75)
    pts = t.select(F.col("l_returnflag").alias("track"), (F.col("l_orderkey") % 2000).cast("double").alias("s"), (rail + F.col("l_discount") - 0.05).alias("t"), F.col("l_tax").alias("z"))
    found = detections(pts, Config(slice_length=25.0, bin_size=0.05, gauge=1.5))
    return found.select("track", "slice", r("t", 4).alias("t"), "pair_mode")


@query("support_metrics")
def support_metrics(spark, d):
    from ..operators import support

    c = table(spark, d, "supplier").select((F.col("s_acctbal") % 50).alias("ax"), (F.col("s_suppkey") % 30).cast("double").alias("ay"))
    seg = c.select("ax", "ay", (F.col("ax") + 3).alias("bx"), (F.col("ay") + 4).alias("by"))
    return support.of_lines(vertices(spark, d), seg, 2.0, 2.0).select("line_id", r("support_ratio", 4).alias("support_ratio"), "n_samples", "max_unsupported")


@query("snap_targets")
def snap_targets(spark, d):
    from ..operators import lines, ranges

    v = vertices(spark, d)
    w = Window.partitionBy("line_id").orderBy("seq")
    ends = v.withColumns({"_a": F.lag("seq").over(w).isNull(), "_b": F.lead("seq").over(w).isNull()}).filter("_a or _b")
    ends = stored(ends.select((F.col("line_id") * 10 + F.col("seq")).alias("point_id"), "line_id", "x", "y"), "points")
    return lines.snap_targets(ends, ranges.segments_of(v), ends.select("line_id", "x", "y"), 1.0).select("point_id", "to_end", "other", r("distance").alias("distance"))


@query("junction_split")
def junction_split(spark, d):
    cuts = vertices(spark, d).groupBy("line_id").agg(F.avg("x").alias("station"))
    return graph.split_at_junctions(vertices(spark, d), cuts).select("line_id", "segment", r("s", 4).alias("s"), r("x", 4).alias("x"), r("y", 4).alias("y"))


@query("curvature_radius")
def curvature_radius(spark, d):
    return seq.quadratic_curvature(samples(spark, d), ["track"], "station", "offset", 300).select("id", r("radius", 2).alias("radius"))


@query("pixel_features")
def pixel_features(spark, d):
    p = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.avg("l_tax").alias("r"), F.avg("l_discount").alias("g"), F.avg("l_quantity").alias("b"))
    return raster.features(p, []).select("row", "col", *(r(c, 4).alias(c) for c in ("sobel_x", "sobel_y", "spread", "line")))


@query("monotone_slack")
def monotone_slack(spark, d):
    return seq.monotone_slack(samples(spark, d), ["track"], "station", "offset", 5.0)


@query("tapered_ends", f"WITH {S}, e AS (SELECT *, station - min(station) OVER (PARTITION BY track) AS a, max(station) OVER (PARTITION BY track) - station AS b, first_value(\"offset\") OVER w AS f, last_value(\"offset\") OVER w AS l FROM s WINDOW w AS (PARTITION BY track ORDER BY station ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT id, (\"offset\" + (10 - f) * least(1, greatest(0, 1 - a / 2000)) + (20 - l) * least(1, greatest(0, 1 - b / 2000))) AS v FROM e")
def tapered_ends(spark, d):
    return samples(spark, d).select("id", seq.tapered(F.col("offset"), ["track"], "station", F.lit(10.0), F.lit(20.0), 2000.0).alias("v"))


@query("tangents", f"WITH {V}, g AS (SELECT line_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, seq, round(CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE dx / sqrt(dx * dx + dy * dy) END, 5) AS tx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy / sqrt(dx * dx + dy * dy) END, 5) AS ty FROM g")
def tangents(spark, d):
    return seq.tangents(vertices(spark, d), ["line_id"], "seq").select("line_id", "seq", r("tx").alias("tx"), r("ty").alias("ty"))


@query("value_counts", "SELECT o_custkey AS track, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("track"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))


@query("roles_with_totals", "SELECT o_orderstatus AS kind, o_orderpriority AS role, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def roles_with_totals(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("_orders")
    return spark.sql("SELECT o_orderstatus AS kind, o_orderpriority AS role, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM _orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")


@query("kinds_pivot", "SELECT o_orderpriority AS role, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def kinds_pivot(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("role")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0)


@query("unmatched_keys", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("overlap_ratio", f"WITH {I} SELECT a.id AS a_id, b.id AS b_id, round(greatest(0, least(a.high, b.high) - greatest(a.low, b.low)) / greatest(least(a.high - a.low, b.high - b.low), 1e-9), 6) AS ratio FROM i a JOIN i b ON a.track = b.track AND a.id < b.id AND a.low <= b.high AND b.low <= a.high WHERE greatest(0, least(a.high, b.high) - greatest(a.low, b.low)) / greatest(least(a.high - a.low, b.high - b.low), 1e-9) >= 0.55")
def overlap_ratio(spark, d):
    from ..functions.scalars import overlap_ratio as ratio
    from ..operators.ranges import interval_join

    i = intervals(spark, d)
    a = i.select("track", F.col("id").alias("a_id"), F.col("low").alias("a0"), F.col("high").alias("a1"))
    b = i.select("track", F.col("id").alias("b_id"), F.col("low").alias("b0"), F.col("high").alias("b1"))
    both = interval_join(a, b, ("a0", "b0"), ("a1", "b1"), 30.0, ["track"]).filter("a_id < b_id").withColumn("ratio", ratio(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")))
    return both.filter("ratio >= 0.55").select("a_id", "b_id", r("ratio", 6).alias("ratio"))


@query("greedy_matches")
def greedy_matches(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("area"), (F.col("o_orderkey") % 97).alias("left"), (F.col("o_custkey") % 89).alias("right"), F.col("o_totalprice").alias("score"))
    return dynamic.greedy_matches(o, ["area"])


@query("stream_slices", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, floor(value / 50)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def stream_slices(spark, d):
    """The histogram per day, as a stream that takes what is there and ends; state and output are kept in the shared folder."""
    import uuid

    from ..storage import shared_dir
    from ..streaming.twins import slice_counts

    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "value")
    counts = slice_counts(rows, "ts", "1 day", "1 day", "value", 50.0)
    done = []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/rows-{number}")
        done.append(number)

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(counts.schema).parquet(f"{place}/rows-{max(done)}") if done else spark.createDataFrame([], counts.schema)
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "bin", "n")


def _visits(spark, d):
    """Events as samples of their users' tracks in time."""
    return table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("time"), F.col("value").cast("double").alias("center"), (1 / (1 + F.col("value"))).cast("double").alias("score"))


_LINKS = {"max_gap": 4 * 86400.0, "max_offset": 40.0, "max_slope": 0.0, "least": 3, "length": 86400.0}


@query("stream_tracks")
def stream_tracks(spark, d):
    """The tracks of all users' events as a stream that takes five days at a time; the rows are those of `batch_tracks`."""
    import uuid

    from ..storage import shared_dir
    from ..streaming.linking import chunked, drained, linked_stream

    place, late = f"{shared_dir(spark).rstrip('/')}/links-{uuid.uuid4().hex}", 5 * 86400
    rows = _visits(spark, d)
    chunked(spark, rows, "time", late, f"{place}/in")
    end = rows.agg(F.max("time").alias("time")).select(F.lit(None).cast("long").alias("user_id"), (F.coalesce("time", F.lit("2000-01-01").cast("timestamp")) + F.expr("INTERVAL 30 DAYS")).alias("time"), F.lit(0.0).alias("center"), F.lit(0.0).alias("score"))
    return drained(lambda s: linked_stream(s, ["user_id"], "time", f"{late} seconds", **_LINKS), f"{place}/in", end, place, 64)


@query("batch_tracks")
def batch_tracks(spark, d):
    rows = _visits(spark, d).withColumn("station", F.unix_millis("time") / 1000)
    return dynamic.linked_tracks(rows, ["user_id"], **_LINKS)
