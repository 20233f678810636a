"""Queries: intervals and centrelines of track bands. Every five customers are a corridor; their orders are features (day to day plus price) and
vertices, dealt to bands by customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Guide
from ..operators import bands
from .registry import query, table

_GUIDE = Guide(0.0, 0.0, 2400.0, 0.0)
_BANDS = [bands.Band("main", 0.0, 0.3, "main_track", whole=True), bands.Band("plus", 5.0, 0.25, "parallel_track"), bands.Band("minus", -5.0, 0.25, "parallel_track")]
_BRIDGES = (bands.Bridge("plus", 300.0, 1500.0, 90.0, "reviewed"), bands.Bridge("minus", 800.0, 2000.0, 60.0, "also reviewed"))
_GAP, _LEAST = 15.0, 35.0

_F = """f AS (SELECT o_custkey // 5 AS track, CASE o_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'plus' ELSE 'minus' END AS band_id, CASE o_custkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 5.0 ELSE -5.0 END::DOUBLE AS centre,
 date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS low, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE + floor(o_totalprice / 8000) AS high, (o_orderkey % 997) / 500.0 - 1 AS off FROM orders)"""
_I = """a AS (SELECT track, band_id, low, high, max(high) OVER (PARTITION BY track, band_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
 b AS (SELECT *, low - before > 15 AND ((band_id = 'plus' AND low - before <= 90 AND before >= 300 AND low <= 1500) OR (band_id = 'minus' AND low - before <= 60 AND before >= 800 AND low <= 2000)) AS bridge FROM a),
 c AS (SELECT *, sum(CASE WHEN before IS NULL OR (low - before > 15 AND NOT bridge) THEN 1 ELSE 0 END) OVER (PARTITION BY track, band_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS g FROM b),
 i AS (SELECT track, band_id, min(low) AS "start", max(high) AS "end", count(*) AS n, count(*) FILTER (bridge) AS n_bridged, coalesce(max(low - before) FILTER (bridge), 0) AS longest FROM c GROUP BY track, band_id, g)"""


def _features(spark, d):
    low = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    k = F.col("o_custkey") % 3
    centre = F.when(k == 0, 0.0).when(k == 1, 5.0).otherwise(-5.0)
    off = F.col("o_orderkey") % 997 / 500.0 - 1
    named = F.when(k == 0, "main").when(k == 1, "plus").otherwise("minus")
    return table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 5).alias("track"), named.alias("band_id"), low.alias("low"), (low + F.floor(F.col("o_totalprice") / 8000)).alias("high"), (centre + off).alias("offset"), low.alias("x"), (centre + off).alias("y"))


@query("band_intervals", f'WITH {_F}, {_I} SELECT track, band_id, "start", "end", n, n_bridged, longest FROM i')
def band_intervals(spark, d):
    return bands.intervals(_features(spark, d), ["track"], _GAP, _BRIDGES).drop("middle", "note")


def _fit_sql(rounds: int) -> str:
    own = "track, band_id, interval_id"
    out = [
        f"WITH {_F}, {_I}",
        """s AS (SELECT track, band_id, low AS x, centre + off AS y FROM f WHERE low BETWEEN 0 AND 2400 AND abs((centre + off) - centre) <= 0.65 + CASE band_id WHEN 'main' THEN 0.3 ELSE 0.25 END)""",
        """p AS (SELECT track, band_id, "start", "end", n, n_bridged FROM i WHERE band_id <> 'main' AND "end" - "start" >= 35 UNION ALL SELECT track, 'main', 0.0, 2400.0, count(*) FILTER (band_id = 'main'), 0 FROM f GROUP BY track)""",
        'q AS (SELECT *, row_number() OVER (PARTITION BY track, band_id ORDER BY "start") - 1 AS interval_id FROM p)',
        f'r0 AS (SELECT {own}, x, y, true AS inn, count(*) OVER (PARTITION BY {own}) AS n0 FROM s JOIN q USING (track, band_id) WHERE x BETWEEN "start" AND "end")',
    ]
    for k in range(1, rounds + 1):
        out += [
            f"f{k} AS (SELECT {own}, avg(x) AS mx, avg(y) AS my, coalesce(CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END, 0) AS b, count(*) AS had FROM r{k - 1} WHERE inn GROUP BY ALL)",
            f"e{k} AS (SELECT r.*, y - my - b * (x - mx) AS res, had FROM r{k - 1} r JOIN f{k} USING ({own}))",
            f"c{k} AS (SELECT {own}, quantile_cont(res, 0.5) AS c FROM e{k} WHERE inn GROUP BY ALL)",
            f"d{k} AS (SELECT {own}, quantile_cont(abs(res - c), 0.5) AS d FROM e{k} JOIN c{k} USING ({own}) WHERE inn GROUP BY ALL)",
            f"k{k} AS (SELECT e.*, inn AND abs(res - c) <= greatest(0.06, least(0.25, 3 * 1.4826 * d)) AS nxt FROM e{k} e JOIN c{k} USING ({own}) JOIN d{k} USING ({own}))",
            f"m{k} AS (SELECT *, sum(nxt::INT) OVER (PARTITION BY {own}) AS kk FROM k{k})",
            f"r{k} AS (SELECT {own}, x, y, CASE WHEN had >= 8 AND kk >= least(8, n0) THEN nxt ELSE inn END AS inn, n0 FROM m{k})",
        ]
    out += [
        f"z AS (SELECT {own}, coalesce(CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END, 0) AS b, avg(x) AS mx, avg(y) AS my, count(*) AS n_inliers, any_value(n0) AS n_samples FROM r{rounds} WHERE inn GROUP BY ALL)",
        "u AS (SELECT track, band_id, median(y) AS usual FROM s GROUP BY ALL)",
        "v AS (SELECT track, band_id, median(centre + off) AS seen FROM f GROUP BY ALL)",
        f"""w AS (SELECT q.*, coalesce(n_samples, 0) AS n_samples, coalesce(n_samples, 0) >= 2 AS ok, n_inliers, b, my - b * mx AS a, CASE WHEN band_id = 'main' THEN 0 ELSE coalesce(usual, seen) END AS usual
 FROM q LEFT JOIN z USING ({own}) LEFT JOIN u USING (track, band_id) LEFT JOIN v USING (track, band_id))""",
        """l AS (SELECT *, CASE WHEN ok THEN b ELSE 0 END AS slope, CASE WHEN ok THEN a ELSE usual END AS base, greatest(1, ceil(("end" - "start") / 25))::INT AS many FROM w)""",
        """t AS (SELECT *, unnest(range(0, many + 1)) AS k FROM l)""",
    ]
    return ", ".join(out) + """ SELECT track, band_id, interval_id, k, n, n_bridged, n_samples, CASE WHEN ok THEN n_inliers ELSE 0 END AS n_inliers, "start" + ("end" - "start") * k / many AS x, base + slope * ("start" + ("end" - "start") * k / many) AS y FROM t"""


@query("band_centrelines", _fit_sql(5))
def band_centrelines(spark, d):
    f = _features(spark, d)
    found = bands.fits(f, f, _GUIDE, _BANDS, ["track"], _GAP, _LEAST, _BRIDGES)
    return bands.centrelines(found, _GUIDE, 25.0).select("track", "band_id", "interval_id", "k", "n", "n_bridged", "n_samples", "n_inliers", "x", "y")
