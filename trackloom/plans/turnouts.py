"""From a point cloud with a turnout to the centrelines of the main track and its branch, and the query over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Frame
from ..operators import dynamic, turnouts
from .centreline import Config, slice_candidates
from .registry import query, table


def pair_candidates(points: DataFrame, config: Config) -> DataFrame:
    """track, slice, s, t, z, score of every rail pair of each slice; where a slice has none, the middle of its outer quantiles if they lie a gauge apart."""
    found = slice_candidates(points, config)
    pair = F.explode("pairs").alias("p")
    dual = found.select("track", "slice", "s", "z", pair).select("track", "slice", "s", ((F.col("p.left_at") + F.col("p.right_at")) / 2).alias("t"), "z", F.col("p.pair_score").cast("double").alias("score"))
    width = F.col("t_high") - F.col("t_low")
    outer = found.filter(F.coalesce(F.size("pairs") < 1, F.lit(True)) & (F.abs(width - config.gauge) <= config.tolerance))
    return dual.unionByName(outer.select("track", "slice", "s", ((F.col("t_low") + F.col("t_high")) / 2).alias("t"), "z", F.lit(0.0).alias("score")))


def turnout(points: DataFrame, frame: Frame, config: Config | None = None, rule: turnouts.Tracing | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """track, role, place, slice, s, t, z, x, y of the main and the branch centreline of each turnout.

    points: track (one region), x, y, z, in or near the region; `frame` has s along the main track.
    """
    config = config or Config()
    rule = rule or turnouts.Tracing(slice_length=config.slice_length)
    local = points.select("track", *(c.alias(n) for n, c in zip("sth", frame.local(F.col("x"), F.col("y"), F.col("z")), strict=True)))
    found = turnouts.turnouts(pair_candidates(local.withColumnRenamed("h", "z"), config), ["track"], rule, anchors)
    line = ["track", "role"]
    for c in ("t", "z"):
        found = dynamic.smoothed(found, line, "place", c, config.smooth_window, 2, "_smooth").withColumn(c, F.col("_smooth")).drop("_smooth")
    found = turnouts.anchored_starts(found, ["track"], rule)
    x, y, z = frame.world(F.col("s"), F.col("t"), F.col("z"))
    return found.withColumns({"x": x, "y": y, "z": z})


@query("turnout_paths")
def turnout_paths(spark, d):
    """Each supplier's line items as candidates of one region: months are slices, quantity is the offset and price the score."""
    t = table(spark, d, "lineitem")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double") / 30
    rows = t.select(F.col("l_suppkey").alias("region"), F.floor(days).alias("slice"), days.alias("s"), (F.col("l_quantity") / 20).alias("t"), "l_tax", F.col("l_extendedprice").alias("score"))
    return turnouts.turnouts(rows.withColumnRenamed("l_tax", "z"), ["region"])
