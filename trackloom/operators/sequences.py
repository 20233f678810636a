"""Operators over ordered rows: smoothing, peaks, islands, intervals, tapers and profiles. All are framed windows, one sort
per key; frames are rows or stations around a row, so no window runs over more than its key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import angle_between, clamp, smoothstep


def by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def moving_average(value: Column, keys: list[str], order: str, half: int) -> Column:
    """Mean of the rows around, of as many as there are at the ends."""
    return F.avg(value).over(by(keys, order).rowsBetween(-half, half))


def moving_sum_same(value: Column, keys: list[str], order: str, window: int) -> Column:
    """Mean over a full window with zeros beyond the ends."""
    half = (window - 1) // 2
    return F.sum(value).over(by(keys, order).rowsBetween(-(window - 1 - half), half)) / window


def moving_average_edge(value: Column, keys: list[str], order: str, half: int) -> Column:
    """Mean over a full window with the end values repeated beyond the ends."""
    w, whole = by(keys, order), Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    before, after = F.greatest(F.lit(half) - (at - 1), F.lit(0)), F.greatest(F.lit(half) - (n - at), F.lit(0))
    inner = F.sum(value).over(w.rowsBetween(-half, half))
    return (inner + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / (2 * half + 1)


def binomial(value: Column, keys: list[str], order: str) -> Column:
    """Weights 1, 2, 1; the ends stay."""
    w = by(keys, order)
    return F.coalesce(0.25 * F.lag(value).over(w) + 0.5 * value + 0.25 * F.lead(value).over(w), value)


def rolling_median(value: Column, keys: list[str], order: str, half: int) -> Column:
    return F.percentile(F.nanvl(value, F.lit(None)), 0.5).over(by(keys, order).rowsBetween(-half, half))


def _ends(value: Column, keys: list[str], order: str, half: int) -> tuple[Column, Column, Column, Column]:
    """First and last value of the key, and how many places of a frame of `half` to each side lie before and after its rows."""
    whole = by(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(by(keys, order)), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.first(value).over(whole), F.last(value).over(whole), F.greatest(F.lit(half) - (at - 1), F.lit(0)), F.greatest(F.lit(half) - (n - at), F.lit(0))


def median_edge(value: Column, keys: list[str], order: str, half: int) -> Column:
    """Median over a full window with the end values repeated beyond the ends."""
    first, last, before, after = _ends(value, keys, order, half)
    inner = F.collect_list(value).over(by(keys, order).rowsBetween(-half, half))
    return F.array_sort(F.concat(inner, F.array_repeat(first, before.cast("int")), F.array_repeat(last, after.cast("int"))))[half]


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of the places from the middle outwards, to four sigma; both sides add up to one."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [x / total for x in raw]


def gaussian_edge(value: Column, keys: list[str], order: str, sigma: float) -> Column:
    """Gaussian smoothing with the end values repeated beyond the ends; unchanged for a sigma of 0."""
    if sigma <= 0:
        return value
    w, weights = by(keys, order), gaussian_weights(sigma)
    first, last, _, _ = _ends(value, keys, order, 0)
    out = weights[0] * value
    for k, x in enumerate(weights[1:], 1):
        out = out + x * (F.coalesce(F.lag(value, k).over(w), first) + F.coalesce(F.lead(value, k).over(w), last))
    return out


def station_median(value: Column, keys: list[str], station: str, reach: int) -> Column:
    return F.percentile(value, 0.5).over(by(keys, station).rangeBetween(-reach, reach))


def odd_window(n: int, spacing: float, length: float, least: int) -> int:
    """Rows of a window of a length: odd, within the number of rows."""
    size = max(least, round(length / max(spacing, 1e-9)))
    size += 1 - size % 2
    if size > n:
        size = n if n % 2 else n - 1
    return max(1, size)


def local_maxima(rows: DataFrame, keys: list[str], order: str, score: str, share: float = 0.2, quantile: float = 0.7) -> DataFrame:
    """Rows not below their neighbours and not below the larger of a share of the most and a quantile of all scores of the key. The ends are none."""
    w, whole = by(keys, order), Window.partitionBy(*keys)
    before, after = F.lag(score).over(w), F.lead(score).over(w)
    least = F.greatest(F.max(score).over(whole) * share, F.percentile(score, quantile).over(whole))
    return rows.withColumns({"_b": before, "_a": after, "_t": least}).filter((F.col(score) > 0) & (F.col(score) >= F.col("_b")) & (F.col(score) >= F.col("_a")) & (F.col(score) >= F.col("_t"))).drop("_b", "_a", "_t")


def suppressed(peaks: DataFrame, keys: list[str], at: str, score: str, least: float) -> DataFrame:
    """Greedy: the best peaks of a key, each at least `least` from those taken before. Ties go to the smaller place. A key's peaks are few,
    so they are folded as an array."""
    item = F.struct((-F.col(score).cast("double")).alias("neg"), F.col(at).cast("double").alias("at"))
    listed = peaks.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    taken = F.aggregate("all", F.array().cast("array<struct<neg:double,at:double>>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["at"] - x["at"]) < least), acc).otherwise(F.array_append(acc, x)))
    return listed.select(*keys, F.explode(taken).alias("p")).select(*keys, F.col("p.at").alias(at), (-F.col("p.neg")).alias(score))


def peak_pairs(peaks: DataFrame, keys: list[str], at: str, score: str, low: float, high: float) -> DataFrame:
    """All pairs of peaks of a key whose distance lies in a range: left, right, gap and the smaller score."""
    a = peaks.select(*keys, F.col(at).alias("left_at"), F.col(score).alias("left_score"))
    b = peaks.select(*keys, F.col(at).alias("right_at"), F.col(score).alias("right_score"))
    gap = F.col("right_at") - F.col("left_at")
    return a.join(b, keys).filter((gap >= low) & (gap <= high) & (gap > 0)).select(*keys, "left_at", "right_at", gap.alias("gap"), F.least("left_score", "right_score").alias("pair_score"))


def adjacent_pairs(peaks: DataFrame, keys: list[str], at: str, low: float, high: float) -> DataFrame:
    after = F.lead(at).over(by(keys, at))
    return peaks.withColumn("right_at", after).withColumn("gap", F.col("right_at") - F.col(at)).filter(F.col("gap").between(low, high))


def islands(rows: DataFrame, keys: list[str], order: str, gap: float, name: str = "island") -> DataFrame:
    """Rows numbered by runs without a step of more than `gap`."""
    w = by(keys, order)
    cut = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def runs(rows: DataFrame, keys: list[str], order: str, state: Column, name: str = "run") -> DataFrame:
    """Rows numbered by runs of one state."""
    w = by(keys, order)
    marked = rows.withColumn("_state", state)
    cut = F.when(F.col("_state").eqNullSafe(F.lag("_state").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return marked.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut", "_state")


def largest_island(rows: DataFrame, keys: list[str], order: str, gap: float) -> DataFrame:
    """Per key the island of the largest span, then the most rows, then the earliest: start, end, span, n."""
    found = islands(rows, keys, order, gap).groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    best = found.withColumn("span", F.col("end") - F.col("start")).groupBy(*keys).agg(F.max_by(F.struct("start", "end", "span", "n"), F.struct("span", "n", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(*keys, "b.*")


def merged_intervals(rows: DataFrame, keys: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Intervals joined where the next starts within `gap` of the farthest end so far: low, high, n."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    so_far = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(so_far.isNull() | (F.col(low) > so_far + gap), 1).otherwise(0)
    grouped = rows.withColumn("_cut", cut).withColumn("_group", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_group").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("_group")


def gaps(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Between consecutive intervals: gap_start, gap_end, where they part."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    out = rows.select(*keys, F.max(high).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gap_start"), F.lead(low).over(w).alias("gap_end"))
    return out.filter("gap_end > gap_start")


def longest_unsupported(rows: DataFrame, keys: list[str], order: str, supported: Column, step: float) -> DataFrame:
    found = runs(rows.withColumn("_ok", supported), keys, order, F.col("_ok")).groupBy(*keys, "run").agg(F.count("*").alias("n"), F.first("_ok").alias("ok"))
    return found.groupBy(*keys).agg((F.coalesce(F.max(F.when(~F.col("ok"), F.col("n"))), F.lit(0)) * step).alias("max_unsupported"))


def filled(value: Column, keys: list[str], order: str, most_jump: float | None = None) -> Column:
    """Missing values straight between their neighbours by place in the order column, and the nearest value beyond the ends. Where the
    neighbours differ by more than most_jump, the one of smaller magnitude."""
    w = by(keys, order)
    at = F.when(value.isNotNull() & ~F.isnan(value), F.struct(F.col(order).cast("double").alias("s"), value.alias("v")))
    back = Window.partitionBy(*keys).orderBy(F.desc(order))  # backwards, as a frame that shrinks costs a pass a row
    a, b = (F.last(at, ignorenulls=True).over(x.rowsBetween(Window.unboundedPreceding, 0)) for x in (w, back))
    mid = F.when(b["s"] == a["s"], a["v"]).otherwise(a["v"] + (F.col(order) - a["s"]) / (b["s"] - a["s"]) * (b["v"] - a["v"]))
    if most_jump is not None:
        mid = F.when(F.abs(b["v"] - a["v"]) > most_jump, F.when(F.abs(a["v"]) <= F.abs(b["v"]), a["v"]).otherwise(b["v"])).otherwise(mid)
    return F.coalesce(mid, a["v"], b["v"])


def despiked(rows: DataFrame, keys: list[str], order: str, value: str, half: int, long_half: int, least: float = 0.18, long_least: float = 0.45) -> DataFrame:
    """Two passes: values farther from the rolling median than a threshold take the median. The thresholds are 6 and 8 times the scaled median
    absolute deviation of the key's residuals, with a floor each. Adds `clean` and `outlier`."""
    whole = Window.partitionBy(*keys)
    out = rows.withColumns({"clean": F.col(value), "outlier": F.lit(False)})
    for reach, floor, times in ((half, least, 6.0), (long_half, long_least, 8.0)):
        out = out.withColumn("_m", rolling_median(F.col("clean"), keys, order, reach)).withColumn("_r", F.col("clean") - F.col("_m"))
        out = out.withColumn("_c", F.percentile("_r", 0.5).over(whole)).withColumn("_d", F.percentile(F.abs(F.col("_r") - F.col("_c")), 0.5).over(whole))
        far = F.abs("_r") > F.greatest(F.lit(floor), times * 1.4826 * F.col("_d"))
        out = out.withColumns({"outlier": F.col("outlier") | F.coalesce(far, F.lit(False)), "clean": F.when(far, F.col("_m")).otherwise(F.col("clean"))}).drop("_m", "_r", "_c", "_d")
    return out


def tapered(value: Column, keys: list[str], station: str, start: Column, end: Column, reach: float, smooth: bool = False) -> Column:
    """Values drawn to a target at either end (null: not), with a weight that falls to 0 over `reach`."""
    whole = Window.partitionBy(*keys).orderBy(station).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s, last = F.col(station) - F.first(station).over(whole), F.last(station).over(whole)
    weight = lambda d: smoothstep(1 - d / reach) if smooth else clamp(1 - d / reach, 0.0, 1.0)
    first_v, last_v = F.first(value).over(whole), F.last(value).over(whole)
    return value + F.coalesce((start - first_v) * weight(s), F.lit(0.0)) + F.coalesce((end - last_v) * weight(last - F.col(station)), F.lit(0.0))


def monotone(value: Column, keys: list[str], order: str, rising: Column) -> Column:
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(rising, F.max(value).over(w)).otherwise(F.min(value).over(w))


def monotone_slack(rows: DataFrame, keys: list[str], order: str, value: str, slack: float = 0.03) -> DataFrame:
    """No value falls more than `slack` below the one before it, as corrected; a fold over each key's values."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("all"))
    item = f"array<struct<o:{rows.schema[order].dataType.simpleString()},v:double>>"
    out = F.aggregate("all", F.array().cast(item), lambda acc, x: F.array_append(acc, F.struct(x["o"].alias("o"), F.when(F.size(acc) == 0, x["v"]).otherwise(F.greatest(x["v"], F.element_at(acc, -1)["v"] - slack)).alias("v"))))
    return listed.select(*keys, F.explode(out).alias("p")).select(*keys, F.col("p.o").alias(order), F.col("p.v").alias(value))


def turn_angles(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The change of direction at each vertex, in degrees; null at the ends."""
    w = by(keys, order)
    dx0, dy0 = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    dx1, dy1 = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    return rows.withColumn("turn", angle_between(dx0, dy0, dx1, dy1))


def tangents(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Unit tangents by central differences, one-sided at the ends, and the normals to their left."""
    w = by(keys, order)
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    out = rows.withColumns({"_dx": dx, "_dy": dy}).withColumn("_l", F.hypot("_dx", "_dy"))
    tx, ty = (F.when(F.col("_l") == 0, F.lit(d)).otherwise(F.col(c) / F.col("_l")) for c, d in (("_dx", 1.0), ("_dy", 0.0)))
    return out.withColumns({"tx": tx, "ty": ty, "nx": -ty, "ny": tx}).drop("_dx", "_dy", "_l")


def slopes(rows: DataFrame, keys: list[str], station: str, value: str) -> DataFrame:
    """Slope to the next row and, at mid-stations, the second difference."""
    w = by(keys, station)
    ds = F.lead(station).over(w) - F.col(station)
    out = rows.withColumn("slope", F.when(ds > 0, (F.lead(value).over(w) - F.col(value)) / ds)).withColumn("_mid", F.col(station) + ds / 2)
    return out.withColumn("curvature", (F.lead("slope").over(w) - F.col("slope")) / (F.lead("_mid").over(w) - F.col("_mid"))).drop("_mid")


def quadratic_curvature(rows: DataFrame, keys: list[str], station: str, value: str, reach: int) -> DataFrame:
    """Curvature and radius from the least-squares parabola of the rows within `reach` along the station; radius 99999 where it is flat."""
    w = by(keys, station).rangeBetween(-reach, reach)
    # Sums around the row itself keep the powers small.
    listed = F.collect_list(F.struct(F.col(station).cast("double").alias("s"), F.col(value).cast("double").alias("v"))).over(w)
    out = rows.withColumn("_near", listed)
    u = lambda p: p["s"] - F.col(station)
    power = lambda k, v=None: F.aggregate("_near", F.lit(0.0), lambda a, p: a + (F.pow(u(p), F.lit(k)) * (p["v"] if v else 1.0)))
    sums = {f"_s{k}": power(k) for k in range(5)} | {f"_t{k}": power(k, True) for k in range(3)}
    out = out.withColumns(sums)
    c = {k: F.col(k) for k in sums}
    det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    base = [c["_s4"], c["_s3"], c["_s2"], c["_s3"], c["_s2"], c["_s1"], c["_s2"], c["_s1"], c["_s0"]]
    right = [c["_t2"], c["_t1"], c["_t0"]]
    whole = det(base)
    swap = lambda k: [right[i // 3] if i % 3 == k else base[i] for i in range(9)]
    a, b = (F.when(F.abs(whole) > 1e-9, det(swap(k)) / whole) for k in (0, 1))
    out = out.withColumn("curvature", 2 * a / F.pow(1 + b * b, F.lit(1.5)))
    return out.withColumn("radius", F.when(F.abs("curvature") > 1e-5, 1 / F.abs("curvature")).otherwise(F.lit(99999.0))).drop("_near", *sums)
