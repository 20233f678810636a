"""The main track among parallel ones: clusters of points around peaks of the offset, and the choice of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import points_in_intervals
from .sequences import by


def peak_clusters(points: DataFrame, peaks: DataFrame, keys: list[str], width: float, gap: float) -> DataFrame:
    """Per peak (keys, peak) the points (keys, s, t) within `width` of it: n, offset (the median t), and the longest stretch of s
    without a gap, the earliest of equal ones: start, end, coverage. A peak without points gives no row.

    Points are counted by cells of one gap's length first. Within a cell no gap is possible, so stretches come from a row per cell,
    however many points a peak has.
    """
    near = peaks.withColumns({"_low": F.col("peak") - width, "_high": F.col("peak") + width})
    met = points_in_intervals(points, near, "t", "_low", "_high", max(2 * width, 1e-9), keys).select(*keys, "peak", "s", "t")
    own = [*keys, "peak"]
    whole = met.groupBy(*own).agg(F.count("*").alias("n"), F.percentile("t", 0.5).alias("offset"))
    cells = met.groupBy(*own, F.floor(F.col("s") / gap).alias("_cell")).agg(F.min("s").alias("_a"), F.max("s").alias("_b"))
    w = by(own, "_cell")
    cut = F.coalesce((F.col("_a") - F.lag("_b").over(w) > gap).cast("int"), F.lit(1))
    parts = cells.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.groupBy(*own, "_part").agg(F.min("_a").alias("start"), F.max("_b").alias("end"))
    longest = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("_s")
    stretch = parts.groupBy(*own).agg(longest).select(*own, "_s.start", "_s.end", (F.col("_s.end") - F.col("_s.start")).alias("coverage"))
    return whole.join(stretch, own)


def main_cluster(clusters: DataFrame, keys: list[str], nearest: float, farthest: float, overlap: float) -> DataFrame:
    """Per key the cluster (peak, n, offset, start, end, coverage) that is the main track, with `two_sided`: one that has neighbours on
    both sides before one that has not, then by coverage, then by points, then the least peak. A neighbour's offset is `nearest` to
    `farthest` away, and the stretches overlap by at least `overlap`."""
    own = [*keys, "peak"]
    reach = clusters.select(*own, "offset", "start", "end").withColumns({"_low": F.col("offset") - farthest, "_high": F.col("offset") + farthest})
    other = clusters.select(*keys, F.col("peak").alias("_peak"), F.col("offset").alias("_at"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = points_in_intervals(other, reach, "_at", "_low", "_high", 2 * farthest, keys).filter("peak <> _peak")
    delta = F.col("_at") - F.col("offset")
    common = F.greatest(F.lit(0.0), F.least("end", "_end") - F.greatest("start", "_start"))
    sides = met.filter(F.abs(delta).between(nearest, farthest) & (common >= overlap)).groupBy(*own).agg(F.max(delta < 0).alias("_l"), F.max(delta > 0).alias("_r"))
    rows = clusters.join(sides, own, "left").withColumn("two_sided", F.coalesce(F.col("_l") & F.col("_r"), F.lit(False))).drop("_l", "_r")
    best = F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct("two_sided", "coverage", "n", -F.col("peak"))).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")
