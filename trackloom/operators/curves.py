"""Curves between two ends, as samples: one row per connector in, one per sample out, all by expressions over a sequence."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import smoothstep


def steps(rows: DataFrame, many: int) -> DataFrame:
    """Each row `many` + 1 times, with k and u = k / many."""
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(many)))).withColumn("u", F.col("k") / many)


def hermite(rows: DataFrame, many: int) -> DataFrame:
    """station, offset along a cubic from (s0, t0) with slope m0 to (s1, t1) with slope m1."""
    u, run = F.col("u"), F.col("s1") - F.col("s0")
    t = (2 * u**3 - 3 * u**2 + 1) * F.col("t0") + (u**3 - 2 * u**2 + u) * run * F.col("m0") + (3 * u**2 - 2 * u**3) * F.col("t1") + (u**3 - u**2) * run * F.col("m1")
    return steps(rows, many).withColumns({"station": F.col("s0") + u * run, "offset": t})


def eased(rows: DataFrame, many: int, power: float = 1.0) -> DataFrame:
    """A smoothstep from t0 to t1; with a power above 1 it starts later."""
    u = F.pow("u", F.lit(power))
    return steps(rows, many).withColumns({"station": F.col("s0") + F.col("u") * (F.col("s1") - F.col("s0")), "offset": F.col("t0") + (F.col("t1") - F.col("t0")) * smoothstep(u)})


def curve_straight_curve(rows: DataFrame, many: int, share: float = 0.25) -> DataFrame:
    """The heading rises over the first share, stays, and falls over the last: offset is its running integral (trapezoids), scaled to end at t1.

    The integral depends on k alone, so it is the same for all rows and is looked up, not summed over each line's samples.
    """
    head = [min(k / many / share, 1.0, (1 - k / many) / share) for k in range(many + 1)]
    area = [0.0, *itertools.accumulate((a + b) / 2 for a, b in itertools.pairwise(head))]
    done = [a / area[-1] if area[-1] > 0 else k / many for k, a in enumerate(area)]
    at = F.element_at(F.array(*map(F.lit, done)), F.col("k") + 1)
    return steps(rows, many).withColumns({"station": F.col("s0") + F.col("u") * (F.col("s1") - F.col("s0")), "offset": F.col("t0") + (F.col("t1") - F.col("t0")) * at})


def bezier_bridge(rows: DataFrame, many: int, most: float = 18.0) -> DataFrame:
    """A cubic from (x0, y0) along (ux0, uy0) to (x1, y1) along (ux1, uy1); handles are a third of the gap, `most` at most."""
    u, v = F.col("u"), 1 - F.col("u")
    handle = F.least(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 3, F.lit(most))

    def along(c: str) -> Column:
        a, b = F.col(f"{c}0"), F.col(f"{c}1")
        return v**3 * a + 3 * v**2 * u * (a + handle * F.col(f"u{c}0")) + 3 * v * u**2 * (b - handle * F.col(f"u{c}1")) + u**3 * b

    return steps(rows, many).withColumns({"x": along("x"), "y": along("y")})


def arcs(rows: DataFrame, many: int) -> DataFrame:
    """Both circle arcs of a radius over the chord (x0, y0)-(x1, y1): side 1 bulges to its left, -1 to its right; none where the radius is too small."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    chord = F.hypot(dx, dy)
    r = rows.withColumn("_c", chord).filter((F.col("_c") > 0) & (F.col("radius") * 2 >= F.col("_c"))).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    half = F.asin(F.col("_c") / (2 * F.col("radius")))
    height = F.sqrt(F.pow("radius", F.lit(2)) - F.pow(F.col("_c") / 2, F.lit(2)))
    nx, ny = -dy / F.col("_c"), dx / F.col("_c")
    cx, cy = (F.col("x0") + F.col("x1")) / 2 - F.col("side") * nx * height, (F.col("y0") + F.col("y1")) / 2 - F.col("side") * ny * height
    start = F.atan2(F.col("y0") - F.col("_cy"), F.col("x0") - F.col("_cx"))
    r = r.withColumns({"_half": half, "_cx": cx, "_cy": cy}).withColumn("_a", start)
    angle = F.col("_a") - F.col("side") * 2 * F.col("_half") * F.col("u")
    return steps(r, many).withColumns({"x": F.col("_cx") + F.col("radius") * F.cos(angle), "y": F.col("_cy") + F.col("radius") * F.sin(angle)}).drop("_c", "_half", "_cx", "_cy", "_a")


def tangent_arc(arc: DataFrame) -> DataFrame:
    """Of both arcs the one whose first step is nearest the direction (ux, uy)."""
    w = Window.partitionBy("line_id", "side").orderBy("k")
    first = arc.withColumns({"_dx": F.lead("x").over(w) - F.col("x"), "_dy": F.lead("y").over(w) - F.col("y")}).filter("k = 0")
    best = first.groupBy("line_id").agg(F.max_by("side", F.struct(((F.col("_dx") * F.col("ux") + F.col("_dy") * F.col("uy")) / F.hypot("_dx", "_dy")).alias("d"), "side")).alias("side"))
    return arc.join(best, ["line_id", "side"])


def guided(rows: DataFrame, evidence: DataFrame, many: int, size: float = 2.0) -> DataFrame:
    """A connector drawn through the medians of its evidence (line_id, station, offset) per bin, never turning back, ends fixed."""
    from .ranges import interpolate

    ends = rows.select("line_id", F.explode(F.array(F.struct(F.col("s0").alias("station"), F.col("t0").alias("offset")), F.struct(F.col("s1").alias("station"), F.col("t1").alias("offset")))).alias("e")).select("line_id", "e.*")
    inner = evidence.join(rows.select("line_id", "s0", "s1"), "line_id").filter((F.col("station") > F.col("s0") + size) & (F.col("station") < F.col("s1") - size))
    inner = inner.groupBy("line_id", F.floor(F.col("station") / size).alias("_b")).agg(F.percentile("station", 0.5).alias("station"), F.percentile("offset", 0.5).alias("offset")).drop("_b")
    at = ends.unionByName(inner).join(rows.select("line_id", "t0", "t1"), "line_id")
    w = Window.partitionBy("line_id").orderBy("station").rowsBetween(Window.unboundedPreceding, 0)
    held = F.least(F.greatest("offset", F.least("t0", "t1")), F.greatest("t0", "t1"))
    at = at.withColumn("offset", F.when(F.col("t1") >= F.col("t0"), F.max(held).over(w)).otherwise(F.min(held).over(w))).select("line_id", "station", "offset")
    spots = steps(rows.select("line_id", "s0", "s1"), many).select("line_id", "k", (F.col("s0") + F.col("u") * (F.col("s1") - F.col("s0"))).alias("at"))
    return interpolate(spots, at, "at", "station", "offset", ["line_id"], "clamp").withColumnRenamed("at", "station")


def rails(samples: DataFrame, gauge: float) -> DataFrame:
    """Both rails of centreline samples (x, y, nx, ny, correction)."""
    side = F.explode(F.array(F.struct(F.lit("left").alias("rail"), F.lit(0.5).alias("f")), F.struct(F.lit("right").alias("rail"), F.lit(-0.5).alias("f"))))
    rows = samples.withColumn("_s", side).withColumn("_d", F.coalesce("correction", F.lit(0.0)) + F.col("_s.f") * gauge)
    return rows.withColumns({"rail": F.col("_s.rail"), "x": F.col("x") + F.col("nx") * F.col("_d"), "y": F.col("y") + F.col("ny") * F.col("_d")}).drop("_s", "_d")


def fused_z(samples: DataFrame, keys: list[str], order: str, most: float = 0.30, half: int = 5) -> DataFrame:
    """z of left_z and right_z: their mean where they agree within `most`, else the one nearer to the median of the agreed ones around; one alone as it is. Adds z and how."""
    agreed = F.when(F.abs(F.col("left_z") - F.col("right_z")) <= most, (F.col("left_z") + F.col("right_z")) / 2)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    rows = samples.withColumn("_m", agreed).withColumn("_c", F.coalesce(F.percentile("_m", 0.5).over(w), F.percentile("_m", 0.5).over(Window.partitionBy(*keys))))
    nearer = F.when(F.abs(F.col("left_z") - F.col("_c")) <= F.abs(F.col("right_z") - F.col("_c")), F.col("left_z")).otherwise(F.col("right_z"))
    both = F.col("left_z").isNotNull() & F.col("right_z").isNotNull()
    z = F.when(F.col("_m").isNotNull(), F.col("_m")).when(both, F.when(F.col("_c").isNull(), (F.col("left_z") + F.col("right_z")) / 2).otherwise(nearer)).otherwise(F.coalesce("left_z", "right_z"))
    how = F.when(F.col("_m").isNotNull(), "mean").when(both, "context").when(F.col("left_z").isNotNull() | F.col("right_z").isNotNull(), "single").otherwise("none")
    return rows.withColumns({"z": z, "how": how}).drop("_m", "_c")


def residual_correction(bins: DataFrame, keys: list[str], size: float, clip: float) -> DataFrame:
    """The shift of a centreline from histograms of rail residuals (side, bin, n): the middle of the fullest bins of each side, averaged over both sides, clipped."""
    most = bins.withColumn("_m", F.max("n").over(Window.partitionBy(*keys, "side"))).filter("n = _m and n > 0")
    side = most.groupBy(*keys, "side").agg(((F.avg("bin") + 0.5) * size).alias("shift"))
    return side.groupBy(*keys).agg(F.greatest(F.lit(-clip), F.least(F.lit(clip), F.avg("shift"))).alias("correction"))


def bridges(intervals: DataFrame, keys: list[str], support: float, weak: float, strict: float) -> DataFrame:
    """Gaps between consecutive intervals (s0, s1, t0, t1, evidence of what follows): bridged by evidence where its support is enough, taken as hidden up to a length, else left."""
    w = Window.partitionBy(*keys).orderBy("s0")
    rows = intervals.select(*keys, F.col("s1").alias("from_s"), F.col("t1").alias("from_t"), F.lead("s0").over(w).alias("to_s"), F.lead("t0").over(w).alias("to_t"), F.lead("evidence").over(w).alias("evidence"))
    gap = F.col("to_s") - F.col("from_s")
    kind = F.when(F.coalesce("evidence", F.lit(0.0)) >= support, "evidence_promoted_bridge").when(gap <= weak, "occlusion_bridge").when((gap <= strict) & (F.coalesce("evidence", F.lit(0.0)) > 0), "weak_bridge")
    return rows.withColumns({"gap": gap, "kind": kind}).filter("gap > 0")


def ramped(rows: DataFrame, many: int, share: float = 0.28) -> DataFrame:
    """Curve, straight, curve in closed form: the slope rises evenly over the first share, stays, and falls evenly over the last."""
    c = min(max(share, 0.05), 0.45)
    u, slope = F.col("u"), 1 / (1 - c)
    bend = lambda x: slope / (2 * c) * x * x
    done = F.when(u <= c, bend(u)).when(u >= 1 - c, 1 - bend(1 - u)).otherwise(slope * (u - c / 2))
    return steps(rows, many).withColumns({"station": F.col("s0") + u * (F.col("s1") - F.col("s0")), "offset": F.col("t0") + (F.col("t1") - F.col("t0")) * done})
