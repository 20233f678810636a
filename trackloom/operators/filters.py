"""Filters over points and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Frame
from .quantiles import exact_quantiles
from .sampling import even


def inside(points: DataFrame, **bounds: float | None) -> DataFrame:
    """Rows within inclusive bounds: x_min, x_max, y_min, ... ; those that are None do not count. They reach the scan."""
    for name, value in bounds.items():
        if value is not None:
            column, side = name.rsplit("_", 1)
            points = points.filter(F.col(column) >= value if side == "min" else F.col(column) <= value)
    return points


def inside_oriented(points: DataFrame, frame: Frame, s: tuple[float, float], t: tuple[float, float], z: tuple[float, float]) -> DataFrame:
    a, b, c = frame.local(F.col("x"), F.col("y"), F.col("z"))
    return points.filter(a.between(*s) & b.between(*t) & c.between(*z))


def highest(points: DataFrame, keep: float) -> DataFrame:
    """The highest share of all points (0.05 to 1)."""
    keep = min(1.0, max(0.05, keep))
    least = exact_quantiles(points, "z", [1 - keep])
    return points if least is None else points.filter(F.col("z") >= least[0])


def slice_tops(points: DataFrame, slice_: str = "slice", shares: tuple[float, ...] = (0.55, 0.45, 0.35)) -> DataFrame:
    """Per slice the points above the first of the quantiles that leaves at least 12 and half of them; all of a slice where none does or
    of fewer than 8 points."""
    w = Window.partitionBy(slice_)
    rows = points.withColumns({"_n": F.count(F.lit(1)).over(w), "_q": F.percentile("z", F.array(*map(F.lit, shares))).over(w)})
    enough = F.greatest(F.lit(12), F.floor(F.col("_n") / 2))
    for k in range(len(shares)):
        rows = rows.withColumn(f"_c{k}", F.sum((F.col("z") >= F.col("_q")[k]).cast("int")).over(w))
    least = F.coalesce(*(F.when(F.col(f"_c{k}") >= enough, F.col("_q")[k]) for k in range(len(shares))))
    return rows.withColumn("_t", F.when(F.col("_n") < 8, F.lit(None)).otherwise(least)).filter("_t is null or z >= _t").drop("_n", "_q", "_t", *(f"_c{k}" for k in range(len(shares))))


def ground(points: DataFrame, cell: float, share: float = 0.1, x: str = "x", y: str = "y") -> DataFrame:
    """gx, gy, ground: a low quantile of z in each cell."""
    return points.groupBy(F.floor(F.col(x) / cell).alias("gx"), F.floor(F.col(y) / cell).alias("gy")).agg(F.percentile("z", share).alias("ground"))


def above_ground(points: DataFrame, cell: float, low: float, high: float, share: float = 0.1, intensity_share: float | None = None) -> DataFrame:
    """Points whose height above their cell's ground lies in a range and, if asked for, whose intensity is at most a quantile of all."""
    keyed = points.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    rows = keyed.join(ground(points, cell, share), ["gx", "gy"]).withColumn("height", F.col("z") - F.col("ground")).filter(F.col("height").between(low, high))
    if intensity_share is not None:
        most = exact_quantiles(points, "intensity", [intensity_share])
        rows = rows.filter(F.col("intensity") <= most[0]) if most else rows
    return rows.drop("gx", "gy")


def station_ground(points: DataFrame, size: float, share: float = 0.2, least: int = 8) -> DataFrame:
    """station_bin, ground: a low quantile per bin; the quantile of all where a bin has too few points."""
    overall = (exact_quantiles(points, "z", [share]) or [None])[0]
    bins = points.groupBy(F.floor(F.col("station") / size).alias("station_bin")).agg(F.count("z").alias("n"), F.percentile("z", share).alias("own"))
    return bins.select("station_bin", F.when(F.col("n") < least, F.lit(overall)).otherwise(F.col("own")).alias("ground"))


def outside_windows(points: DataFrame, windows: list[tuple[float, float, float, float]], pad: float = 0.0) -> DataFrame:
    """Points (s, t) in none of the padded boxes (s0, s1, t0, t1), which are parameters."""
    hit = F.lit(False)
    for s0, s1, t0, t1 in windows:
        hit = hit | (F.col("s").between(s0 - pad, s1 + pad) & F.col("t").between(t0 - pad, t1 + pad))
    return points.filter(~hit)


def corridor(points: DataFrame, keys: list[str], margin: float, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Points within the quantiles of t of their component, widened by a margin."""
    w = Window.partitionBy(*keys)
    rows = points.withColumn("_q", F.percentile("t", F.array(F.lit(low), F.lit(high))).over(w))
    return rows.filter(F.col("t").between(F.col("_q")[0] - margin, F.col("_q")[1] + margin)).drop("_q")


def without_outliers(rows: DataFrame, keys: list[str], columns: tuple[str, ...] = ("t", "z"), times: float = 4.0) -> DataFrame:
    """Rows within `times` the median absolute deviation (and 1e-6) on all columns; untouched where a key has fewer than 5 rows or would keep fewer than 4."""
    w = Window.partitionBy(*keys)
    out, near = rows, F.lit(True)
    for c in columns:
        out = out.withColumn(f"_m{c}", F.percentile(c, 0.5).over(w)).withColumn(f"_d{c}", F.percentile(F.abs(F.col(c) - F.col(f"_m{c}")), 0.5).over(w))
        near = near & (F.abs(F.col(c) - F.col(f"_m{c}")) <= times * (F.col(f"_d{c}") + 1e-6))
    out = out.withColumn("_near", near).withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.sum(F.col("_near").cast("int")).over(w)})
    return out.filter("_near or _n < 5 or _k < 4").drop("_near", "_n", "_k", *(f"_{a}{c}" for a in "md" for c in columns))


def track_like(segments: DataFrame, ux: float, uy: float, degrees: float = 20.0, span: float = 4.0, length: float = 1.0) -> DataFrame:
    """Segments (dx, dy, t_span, length) along an axis, in either direction."""
    from ..functions.scalars import axis_angle

    return segments.filter((axis_angle(F.col("dx"), F.col("dy"), F.lit(ux), F.lit(uy)) <= degrees) & (F.col("t_span") <= span) & (F.col("length") >= length))


def checked(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows as they are; an error, when they are read, if one breaks the condition."""
    return rows.filter(F.coalesce(F.assert_true(condition, F.lit(message)).isNull(), F.lit(True)))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def turnout_overlap(features: DataFrame, turnouts: DataFrame, most: float = 0.25) -> DataFrame:
    """Features (feature_id, band_id, s0, s1) that turnouts (t0, t1) overlap by less than a share; the main band is exempt."""
    from .ranges import interval_join

    met = interval_join(features, turnouts.select("t0", "t1"), ("s0", "t0"), ("s1", "t1"), 50.0)
    part = F.sum(F.greatest(F.lit(0.0), F.least("s1", "t1") - F.greatest("s0", "t0")))
    bad = met.groupBy("feature_id", "band_id", "s0", "s1").agg(part.alias("part")).filter((F.col("part") >= most * F.greatest(F.col("s1") - F.col("s0"), F.lit(1e-9))) & (F.col("band_id") != "main"))
    return features.join(bad.select("feature_id"), "feature_id", "left_anti")


def visible(points: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float], most: int, order: str) -> DataFrame:
    """Points within a view whose bounds may stand in any order, evenly thinned out to at most `most`."""
    (x0, x1), (y0, y1) = sorted(x_range), sorted(y_range)
    return even(inside(points, x_min=x0, x_max=x1, y_min=y0, y_max=y1), order, most)
