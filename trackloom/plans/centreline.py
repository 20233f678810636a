"""From a point cloud to centrelines: frame, slices, rail peaks, pairs, one choice per slice, smoothing, world coordinates.

What a slice holds is found by expressions over all slices at once. Only the choice among a slice's candidates depends on the
slice before; it runs per track over a few rows per slice, never over points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Frame
from ..functions.scalars import pair_quality
from ..operators import aggregates, dynamic, filters, frames, sequences
from ..shipping import map_groups


@dataclass(frozen=True)
class Config:
    gauge: float = 1.5
    tolerance: float = 0.35
    slice_length: float = 1.0
    least_points: int = 12
    bin_size: float = 0.05
    peak_share: float = 0.35
    apart: float = 0.3
    most_jump: float = 0.6
    smooth_window: int = 7
    lateral: str = "smooth"  # free, smooth or straight

    def __post_init__(self):
        if self.lateral not in ("free", "smooth", "straight"):
            raise ValueError("lateral is free, smooth or straight")
        if min(self.gauge, self.slice_length, self.bin_size) <= 0:
            raise ValueError("gauge, slice length and bin size are positive")


def slice_candidates(points: DataFrame, config: Config) -> DataFrame:
    """Per track and slice: s, z, the low and high quantile of t, and arrays of peaks (t, score) and pairs (left, right, score).
    points: track, s, t, z."""
    k = ["track", "slice"]
    rows = points.withColumn("slice", F.floor(F.col("s") / config.slice_length))
    rows = rows.withColumn("_key", F.struct(*k))
    tops = filters.slice_tops(rows, "_key").drop("_key")
    base = tops.groupBy(*k).agg(F.count("*").alias("n"), F.avg("s").alias("s"), F.percentile("z", 0.5).alias("z"), F.percentile("t", 0.1).alias("t_low"), F.percentile("t", 0.9).alias("t_high")).filter(F.col("n") >= config.least_points)
    bins = aggregates.dense(aggregates.histogram(tops, "t", config.bin_size, k), k)
    # A bin of zeros at either end, so that a peak at the edge has neighbours.
    ends = bins.groupBy(*k).agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(*k, F.explode(F.array(F.col("a") - 1, F.col("b") + 1)).alias("bin"), F.lit(0).cast("long").alias("n"))
    smooth = bins.unionByName(ends).withColumn("score", sequences.moving_average(F.col("n"), k, "bin", 1)).withColumn("at", (F.col("bin") + 0.5) * config.bin_size)
    peaks = sequences.suppressed(sequences.local_maxima(smooth, k, "bin", "score", config.peak_share, 0.0), k, "at", "score", config.apart)
    pairs = sequences.peak_pairs(peaks, k, "at", "score", config.gauge - config.tolerance, config.gauge + config.tolerance)
    listed = peaks.groupBy(*k).agg(F.collect_list(F.struct("at", "score")).alias("peaks"))
    paired = pairs.groupBy(*k).agg(F.collect_list(F.struct("left_at", "right_at", "pair_score")).alias("pairs"))
    return base.join(listed, k, "left").join(paired, k, "left")


def choose(group: pd.DataFrame, config: Config) -> pd.DataFrame:
    """One centre per slice, in order: the pair of the best score near the centre before; else the outer quantiles if they lie a gauge apart;
    else one rail, from which the other is inferred by the side on which it lay."""
    out, before = [], None
    for row in group.sort_values("slice").itertuples(index=False):
        pairs = [(p["left_at"], p["right_at"], p["pair_score"]) for p in (row.pairs if row.pairs is not None else [])]
        if before is not None:
            pairs = [p for p in pairs if abs((p[0] + p[1]) / 2 - before) <= config.most_jump]
        found = None
        if pairs:
            left, right, _ = max(pairs, key=lambda p: (p[2] - (0 if before is None else abs((p[0] + p[1]) / 2 - before)), -p[0]))
            found = (left, right, "dual")
        elif abs(row.t_high - row.t_low - config.gauge) <= config.tolerance and (before is None or abs((row.t_high + row.t_low) / 2 - before) <= config.most_jump):
            found = (row.t_low, row.t_high, "quantile_fallback")
        elif before is not None and row.peaks is not None:
            sides = [(abs(p["at"] - before - side * config.gauge / 2), p["at"], side) for p in row.peaks for side in (-1, 1)]
            near = min(sides, default=None)
            if near and near[0] <= config.tolerance:
                _, at, side = near
                found = (at, at + config.gauge, "single_left") if side < 0 else (at - config.gauge, at, "single_right")
        if found:
            before = (found[0] + found[1]) / 2
            out.append((row.track, row.slice, row.s, before, row.z, found[0], found[1], found[2]))
    return pd.DataFrame(out, columns=["track", "slice", "s", "t", "z", "left_t", "right_t", "pair_mode"])


def detections(points: DataFrame, config: Config) -> DataFrame:
    """track, slice, s, t, z, left_t, right_t, pair_mode of each slice with a centre."""
    found = slice_candidates(points, config)
    kind = points.schema["track"].dataType.simpleString()
    return map_groups(found.groupBy("track"), lambda g: choose(g, config), f"track {kind}, slice long, s double, t double, z double, left_t double, right_t double, pair_mode string", points.sparkSession)


def centreline(points: DataFrame, config: Config | None = None, frame: Frame | None = None) -> DataFrame:
    """track, slice, s, t, z, pair_mode, x, y of the centreline of one track (points x, y, z) in the frame of its points."""
    config = config or Config()
    frame = frame or frames.pca_frame(points)
    local = frames.to_local(points, frame).select(F.lit(0).alias("track"), "s", "t", F.col("h").alias("z"))
    rows = filters.without_outliers(detections(local, config), ["track"])
    if config.lateral == "smooth":
        rows = dynamic.smoothed(rows, ["track"], "slice", "t", config.smooth_window, 2, "_t").withColumn("t", F.col("_t")).drop("_t")
    elif config.lateral == "straight":
        fit = aggregates.robust_fit(rows.select("track", F.col("s").alias("station"), F.col("t").alias("offset")), ["track"]).select("track", "slope", "intercept")
        rows = rows.join(fit, "track").withColumn("t", F.col("intercept") + F.col("slope") * F.col("s")).drop("slope", "intercept")
    x, y, z = frame.world(F.col("s"), F.col("t"), F.col("z"))
    return rows.withColumns({"x": x, "y": y, "z": z})


def tracks(points: DataFrame, offsets: dict[str, float], reach: float, config: Config | None = None) -> DataFrame:
    """Several tracks of one cloud (s, t, z): each point counts for the tracks whose offset lies within reach."""
    hit = F.explode(F.array(*(F.struct(F.lit(n).alias("track"), F.lit(float(o)).alias("o")) for n, o in offsets.items())))
    near = points.withColumn("_o", hit).filter(F.abs(F.col("t") - F.col("_o.o")) <= reach).select(F.col("_o.track").alias("track"), "s", "t", "z")
    return detections(near, config or Config())


def confidence(rows: DataFrame) -> DataFrame:
    """Per track: slices, length, mean quality of the ways pairs were found, evenness of the gauge and their product."""
    gauge = F.col("right_t") - F.col("left_t")
    out = rows.groupBy("track").agg(F.count("*").alias("slices"), (F.max("s") - F.min("s")).alias("length"), F.avg(pair_quality(F.col("pair_mode"))).alias("mode_quality"), F.coalesce(F.stddev_pop(gauge), F.lit(0.0)).alias("gauge_spread"))
    return out.withColumn("confidence", F.col("mode_quality") * F.greatest(F.lit(0.0), 1 - F.col("gauge_spread") / 0.5))


def branch(main: DataFrame, other: DataFrame, apart: float = 0.45) -> DataFrame:
    """Where a branch (s, t) leaves the main line (s, t): the branch rows from the last station at which both lie within `apart`."""
    from ..operators.ranges import interpolate

    both = interpolate(other.withColumn("_k", F.lit(0)), main.select(F.lit(0).alias("_k"), "s", F.col("t").alias("main_t")), "s", "s", "main_t", ["_k"], "extrapolate").drop("_k")
    close = both.filter(F.abs(F.col("t") - F.col("main_t")) <= apart).agg(F.max("s").alias("from_s"))
    return both.crossJoin(F.broadcast(close)).filter(F.col("from_s").isNull() | (F.col("s") >= F.col("from_s"))).drop("from_s")


def synthetic(spark, seed: int = 7, length: float = 40.0, many: int = 160, offset: float = 0.0, gauge: float = 1.5) -> tuple[DataFrame, np.ndarray]:
    """A seeded track for tests: rails, ballast and clutter around a gentle curve; and its true centreline (s, t, z)."""
    r = np.random.default_rng(seed)
    s = np.linspace(0, length, many)
    truth = np.column_stack([s, offset + 0.12 * np.sin(s / 10), 0.02 * np.sin(s / 14)])
    parts = []
    for side in (-0.5, 0.5):
        rail = np.repeat(truth, 6, axis=0) + [0, side * gauge, 0.08]
        parts.append(rail + r.normal(0, [0.02, 0.025, 0.01], rail.shape))
    ballast = np.repeat(truth, 8, axis=0)
    parts.append(ballast + np.column_stack([r.normal(0, 0.05, len(ballast)), r.uniform(-1.5, 1.5, len(ballast)), r.normal(-0.04, 0.025, len(ballast))]))
    a = np.radians(28)
    local = np.vstack(parts)
    xy = local[:, :2] @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + [100, -30]
    return spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "z": local[:, 2] + 5})), truth
