"""A guide from evidence alone: the direction in which points line up, the main track among the parallel ones, and its chord."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Guide
from . import aggregates, mainline, sampling, sequences
from .frames import pca_axes


def best_angle(points: DataFrame, centre: float, reach: float, step: float, size: float) -> float:
    """The angle, of those around a centre, across which the offsets of points (x, y) pile up most; the least of equal ones. One aggregate over all angles."""
    many = round(2 * reach / step)
    angles = [centre - reach + k * step for k in range(many + 1)]
    found = aggregates.offset_score(points, angles, size).agg(F.min(F.struct((-F.col("score")).alias("s"), "angle")).alias("b")).first()
    return centre if found is None or found["b"] is None else float(found["b"]["angle"])


def refined_angle(points: DataFrame, first: float, size: float = 0.2, reach: float = 0.8, coarse: float = 0.002, fine: float = 0.0001, most: int = 12_000) -> float:
    """`first` turned by up to `reach` degrees, from coarse to fine, to where points line up; from 0 to pi. Points beyond `most` are sampled evenly
    by x and y for the search of the angle, and for nothing else."""
    from ..storage import stored

    n = points.count()
    some = stored(points.select("x", "y") if n <= most else sampling.even(points.select("x", "y", F.struct("x", "y").alias("_o")), "_o", most).select("x", "y"), "angle")
    at = best_angle(some, first, math.radians(reach), math.radians(coarse), size)
    at = best_angle(some, at, math.radians(3 * coarse), math.radians(fine), size)
    return at % math.pi


def offset_peaks(points: DataFrame, size: float, least: int, apart: float) -> DataFrame:
    """peak, n: offsets (t) at which the smoothed histogram (five bins) of points (t) is as high as on both sides and has `least` points; the highest first, none within
    `apart` of one before. Bins count from the least offset."""
    low = points.agg(F.min("t")).first()[0]
    if low is None:
        return points.sparkSession.createDataFrame([], "peak double, n long")
    bins = points.groupBy(F.floor((F.col("t") - low) / size).alias("bin")).agg(F.count("*").alias("n"))
    last = bins.agg(F.max("bin")).first()[0]
    # Each bin counts for the five bins around it, so empty bins between full ones are there too.
    around = bins.select(F.explode(F.sequence(F.col("bin") - 3, F.col("bin") + 3)).alias("b"), "bin", "n")
    near = lambda k: F.coalesce(F.sum(F.when(F.abs(F.col("bin") - F.col("b") - k) <= 2, F.col("n"))), F.lit(0))
    smooth = around.groupBy("b").agg(near(0).alias("n"), near(-1).alias("before"), near(1).alias("after"))
    tops = smooth.filter((F.col("n") >= least) & (F.col("n") >= F.col("before")) & (F.col("n") >= F.col("after")) & F.col("b").between(2, max(2, last + 1 - 2) - 1))
    tops = tops.select(F.lit(0).alias("_all"), (low + (F.col("b") + 0.5) * size).alias("peak"), "n")
    return sequences.suppressed(tops, ["_all"], "peak", "n", apart).select("peak", "n")


def evidence_guide(segments: DataFrame, size: float = 0.2, width: float = 0.8, least: int = 1000, apart: float = 2.0, gap: float = 40.0, nearest: float = 3.5, farthest: float = 6.5, overlap: float = 300.0) -> tuple[Guide, dict]:
    """The chord of the main track among candidate lines (line_id, seq, x, y), and what was found on the way.

    The defaults are fixed values. The direction is the length-weighted axis of all segments, refined; the main track is the cluster of points around an offset peak
    with neighbours on both sides, else the longest; a second fit over its points alone turns the chord, which then spans their longest stretch.
    """
    from ..storage import stored
    from .ranges import segments_of

    points = stored(segments.select("x", "y").dropna(), "points")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    first = aggregates.double_angle(segments_of(segments, "line_id").select(dx.alias("dx"), dy.alias("dy")), []).first()
    if first is None or first["angle"] is None:
        raise ValueError("no segments to take a direction from")
    angle = refined_angle(points, first["angle"] % math.pi, size)

    def turned(df: DataFrame, a: float) -> DataFrame:
        return df.withColumns({"s": F.col("x") * math.cos(a) + F.col("y") * math.sin(a), "t": F.col("y") * math.cos(a) - F.col("x") * math.sin(a)})

    local = turned(points, angle)
    peaks = stored(offset_peaks(local, size, least, apart), "peaks")
    clusters = stored(mainline.peak_clusters(local.withColumn("_all", F.lit(0)), peaks.withColumn("_all", F.lit(0)).select("_all", "peak"), ["_all"], width, gap), "clusters")
    main = mainline.main_cluster(clusters, ["_all"], nearest, farthest, overlap).first()
    if main is None:
        raise ValueError("no offset at which enough points line up")
    own = points.withColumn("_t", F.col("y") * math.cos(angle) - F.col("x") * math.sin(angle)).filter(F.abs(F.col("_t") - main["peak"]) <= width).drop("_t")
    axis = pca_axes(own.withColumn("z", F.lit(0.0))).first()["angle"]
    axis = angle if axis is None else axis % math.pi
    placed = turned(own, axis).withColumn("_all", F.lit(0))
    stretch = mainline.peak_clusters(placed.withColumn("t", F.lit(0.0)), points.sparkSession.createDataFrame([(0, 0.0)], "_all int, peak double"), ["_all"], width, gap).first()
    offset = placed.agg(F.percentile("t", 0.5)).first()[0]
    at = lambda s: (s * math.cos(axis) - offset * math.sin(axis), s * math.sin(axis) + offset * math.cos(axis))
    guide = Guide(*at(stretch["start"]), *at(stretch["end"]))
    return guide, {"angle": angle, "axis": axis, "peak": main["peak"], "offset": offset, "two_sided": main["two_sided"], "peaks": clusters.count()}
