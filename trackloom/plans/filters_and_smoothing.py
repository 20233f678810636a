"""Queries: edge-true smoothing, closed-form curves, anchors, views and regions of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import curves, filters, frames
from ..operators import sequences as seq
from .registry import P, S, V, points, query, samples, table, vertices

_SIGMA, _HALF = 2.0, 3
_TERMS = " + ".join([f"{seq.gaussian_weights(_SIGMA)[0]!r} * \"offset\""] + [f"{x!r} * (coalesce(lag(\"offset\", {k}) OVER w, f) + coalesce(lead(\"offset\", {k}) OVER w, l))" for k, x in enumerate(seq.gaussian_weights(_SIGMA)[1:], 1)])
_ENDED = f"{S}, e AS (SELECT *, first_value(\"offset\") OVER a AS f, last_value(\"offset\") OVER a AS l, row_number() OVER (PARTITION BY track ORDER BY station) AS pos, count(*) OVER (PARTITION BY track) AS n FROM s WINDOW a AS (PARTITION BY track ORDER BY station ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query("gaussian_profile", f"WITH {_ENDED} SELECT id, {_TERMS} AS smooth FROM e WINDOW w AS (PARTITION BY track ORDER BY station)")
def gaussian_profile(spark, d):
    return samples(spark, d).select("id", seq.gaussian_edge(F.col("offset"), ["track"], "station", _SIGMA).alias("smooth"))


@query("median_profile", f"WITH {_ENDED}, w AS (SELECT *, list(\"offset\") OVER (PARTITION BY track ORDER BY station ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS around FROM e) SELECT id, list_sort(list_concat(list_concat(around, [f FOR x IN range(greatest({_HALF} - pos + 1, 0))]), [l FOR x IN range(greatest({_HALF} - n + pos, 0))]))[{_HALF} + 1] AS middle FROM w")
def median_profile(spark, d):
    return samples(spark, d).select("id", seq.median_edge(F.col("offset"), ["track"], "station", _HALF).alias("middle"))


@query("ramped_curve", "WITH k AS (SELECT o_orderkey AS line_id, 10 + o_totalprice / 10000 AS s1, (o_custkey % 7)::DOUBLE AS t1, unnest(range(9)) AS k FROM orders), u AS (SELECT *, k / 8 AS u FROM k) SELECT line_id, k::INT AS k, u * s1 AS station, 1 + t1 * CASE WHEN u <= 0.28 THEN u * u / (2 * 0.28 * 0.72) WHEN u >= 0.72 THEN 1 - (1 - u) * (1 - u) / (2 * 0.28 * 0.72) ELSE (u - 0.14) / 0.72 END AS \"offset\" FROM u")
def ramped_curve(spark, d):
    ends = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_id"), F.lit(0.0).alias("s0"), (10 + F.col("o_totalprice") / 10000).alias("s1"), F.lit(1.0).alias("t0"), (1 + F.col("o_custkey") % 7).cast("double").alias("t1"))
    return curves.ramped(ends, 8).select("line_id", "k", "station", "offset")


@query("anchor_scores", f"WITH {S}, a AS (SELECT id, CASE WHEN id % 5 <> 0 THEN (id % 7 - 3)::DOUBLE END AS off FROM s) SELECT id, coalesce(abs(off) > 2.5, false) AS far, greatest(0, 1 - abs(coalesce(off, 0)) / 2.5) * 14 AS bonus FROM a")
def anchor_scores(spark, d):
    s = samples(spark, d).withColumn("anchor", F.when(F.col("id") % 5 != 0, (F.col("id") % 7 - 3).cast("double")))
    return s.select("id", C.anchor_far(F.lit(0.0), F.col("anchor")).alias("far"), C.anchor_bonus(F.abs(F.coalesce("anchor", F.lit(0.0)))).alias("bonus"))


@query("visible_range", f"WITH {P}, v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM p WHERE x BETWEEN -12 AND 12 AND y BETWEEN -8 AND 15), k AS (SELECT unnest(range(100)) AS k) SELECT DISTINCT id FROM v, k WHERE n <= 100 OR pos = (k * (n - 1)) // 99")
def visible_range(spark, d):
    return filters.visible(points(spark, d), (12.0, -12.0), (-8.0, 15.0), 100, "id").select("id")


@query("region_of_interest", f"WITH {V}, b AS (SELECT min((x - 1) * 0.6 + (y - 2) * 0.8) - 5 AS s0, max((x - 1) * 0.6 + (y - 2) * 0.8) + 5 AS s1, min((y - 2) * 0.6 - (x - 1) * 0.8) - 3 AS t0, max((y - 2) * 0.6 - (x - 1) * 0.8) + 3 AS t1 FROM v), c AS (SELECT 0 AS corner, s0 AS s, t0 AS t FROM b UNION ALL SELECT 1, s1, t0 FROM b UNION ALL SELECT 2, s1, t1 FROM b UNION ALL SELECT 3, s0, t1 FROM b UNION ALL SELECT 4, s0, t0 FROM b) SELECT corner::INT AS corner, 1 + s * 0.6 - t * 0.8 AS x, 2 + s * 0.8 + t * 0.6 AS y FROM c")
def region_of_interest(spark, d):
    return frames.oriented_roi(vertices(spark, d), (1.0, 2.0), (0.6, 0.8), 5.0, 3.0)
