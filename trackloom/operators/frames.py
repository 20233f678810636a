"""Frames estimated from points, and points projected into frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Frame, Guide
from .quantiles import exact_quantiles


def pca_frame(points: DataFrame, forced_up: bool = False) -> Frame:
    """Origin at mean x, mean y, median z; axis along the larger eigenvector of the sample covariance."""
    z = (exact_quantiles(points, "z", [0.5]) or [None])[0]
    r = points.agg(F.avg("x"), F.avg("y"), F.lit(z).cast("double"), F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")).first()
    if r[0] is None:
        raise ValueError("a frame needs points")
    angle = 0.5 * math.atan2(2 * (r[4] or 0.0), (r[3] or 0.0) - (r[5] or 0.0))
    ux, uy = math.cos(angle), math.sin(angle)
    if forced_up and uy < 0:
        ux, uy = -ux, -uy
    return Frame(r[0], r[1], r[2] or 0.0, ux, uy)


def pca_axes(points: DataFrame, *keys: str) -> DataFrame:
    """Per group: n, mean x and y, median z and the angle of the axis."""
    out = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.percentile("z", 0.5).alias("oz"), F.var_samp("x").alias("_xx"), F.covar_samp("x", "y").alias("_xy"), F.var_samp("y").alias("_yy"))
    return out.withColumn("angle", 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))).drop("_xx", "_xy", "_yy")


def to_local(points: DataFrame, frame: Frame) -> DataFrame:
    s, t, z = frame.local(F.col("x"), F.col("y"), F.col("z"))
    return points.withColumns({"s": s, "t": t, "h": z})


def to_world(points: DataFrame, frame: Frame) -> DataFrame:
    x, y, z = frame.world(F.col("s"), F.col("t"), F.col("h"))
    return points.withColumns({"x": x, "y": y, "z": z})


def to_guide(points: DataFrame, guide: Guide) -> DataFrame:
    station, offset = guide.project(F.col("x"), F.col("y"))
    return points.withColumns({"station": station, "offset": offset})


def guide_of(line: DataFrame) -> Guide:
    """The chord of a line of vertices (seq, x, y)."""
    r = line.agg(F.min_by("x", "seq"), F.min_by("y", "seq"), F.max_by("x", "seq"), F.max_by("y", "seq")).first()
    return Guide(r[0], r[1], r[2], r[3])


def bounding_box(points: DataFrame, frame: Frame, low: float = 0.02, high: float = 0.98, margin: float = 1.0) -> list[tuple[float, float]]:
    """Corners, in order, of the box of the quantiles along the frame, widened by a margin."""
    s, t, _ = frame.local(F.col("x"), F.col("y"), F.lit(0.0))
    local = points.select(s.alias("s"), t.alias("t"))
    (s0, s1), (t0, t1) = (exact_quantiles(local, c, [low, high]) for c in "st")
    out = []
    for a, b in ((s0 - margin, t0 - margin), (s1 + margin, t0 - margin), (s1 + margin, t1 + margin), (s0 - margin, t1 + margin)):
        out.append((a * frame.ux - b * frame.uy + frame.ox, a * frame.uy + b * frame.ux + frame.oy))
    return out


def manual_anchors(rows: DataFrame, frame: Frame) -> DataFrame:
    """Anchors (x, y, z, z may be null) in the frame by s; of those at one s (within 1e-6) the last stays."""
    from pyspark.sql import Window

    local = to_local(rows.withColumn("z", F.coalesce("z", F.lit(frame.oz))), frame)
    after = F.lead("s").over(Window.orderBy("s"))
    return local.withColumn("_next", after).filter("_next is null or _next - s >= 1e-6").drop("_next")


def oriented_roi(points: DataFrame, origin: tuple[float, float], along: tuple[float, float], before: float, beside: float) -> DataFrame:
    """x, y of the corners 0 to 4 (the last is the first) of the rectangle along an axis that holds all points (x, y) with a margin."""
    (ox, oy), (ux, uy) = origin, along
    s, t = (F.col("x") - ox) * ux + (F.col("y") - oy) * uy, (F.col("y") - oy) * ux - (F.col("x") - ox) * uy
    box = points.agg((F.min(s) - before).alias("s0"), (F.max(s) + before).alias("s1"), (F.min(t) - beside).alias("t0"), (F.max(t) + beside).alias("t1"))
    corners = F.array(*(F.struct(F.col(a).alias("s"), F.col(b).alias("t")) for a, b in (("s0", "t0"), ("s1", "t0"), ("s1", "t1"), ("s0", "t1"), ("s0", "t0"))))
    out = box.select(F.posexplode(corners).alias("corner", "c"))
    return out.select("corner", (F.lit(ox) + F.col("c.s") * ux - F.col("c.t") * uy).alias("x"), (F.lit(oy) + F.col("c.s") * uy + F.col("c.t") * ux).alias("y"))
