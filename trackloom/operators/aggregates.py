"""Aggregates: histograms, robust lines, orientation, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored


def histogram(rows: DataFrame, value: str, size: float, keys: list[str] | None = None, origin: float = 0.0) -> DataFrame:
    return rows.groupBy(*(keys or []), F.floor((F.col(value) - origin) / size).alias("bin")).agg(F.count("*").alias("n"))


def dense(bins: DataFrame, keys: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """The histogram with its empty bins (n = 0) between the first and the last of each key, or two given ones."""
    ends = bins.groupBy(*keys).agg((F.min("bin") if low is None else F.lit(low)).alias("_a"), (F.max("bin") if high is None else F.lit(high)).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence(F.col("_a").cast("long"), F.col("_b").cast("long"))).alias("bin")).join(bins, [*keys, "bin"], "left").fillna(0, ["n"])


def closed_bins(rows: DataFrame, value: str, edges: int, low: float, high: float) -> Column:
    """Bin of `edges` equal bins over a range whose last bin holds its upper end; null outside."""
    v = F.col(value)
    return F.when(v.between(low, high), F.least(F.floor((v - low) / ((high - low) / edges)), F.lit(edges - 1)))


def grid(rows: DataFrame, s: str, t: str, s_size: float, t_size: float, weight: Column) -> DataFrame:
    """Two-dimensional histogram: sums of weights, counts, and the mean of z."""
    return rows.groupBy(F.floor(F.col(s) / s_size).alias("s_bin"), F.floor(F.col(t) / t_size).alias("t_bin")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"), F.avg("z").alias("z_mean"))


def occupancy(rows: DataFrame, size: float, most: int = 65535) -> DataFrame:
    return rows.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def histogram_percentile(bins: DataFrame, keys: list[str], share: float, size: float) -> DataFrame:
    """The centre of the first bin at which the running count reaches a share of all."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = bins.withColumns({"_c": F.sum("n").over(w), "_all": F.sum("n").over(Window.partitionBy(*keys))}).filter(F.col("_c") >= F.col("_all") * share)
    return rows.groupBy(*keys).agg(((F.min("bin") + 0.5) * size).alias("value"))


def rank_quantile(value: Column, share: float) -> Column:
    """The element at rank round((n - 1) * share), half to even; not interpolated."""
    listed = F.array_sort(F.collect_list(value))
    return F.element_at(listed, (F.bround((F.size(listed) - 1) * F.lit(share)) + 1).cast("int"))


def index_quantile(value: Column, share: float) -> Column:
    """The element at index int(n * share)."""
    listed = F.array_sort(F.collect_list(value))
    return F.element_at(listed, F.least(F.floor(F.size(listed) * F.lit(share)) + 1, F.size(listed)).cast("int"))


def spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Station and offset ranges, medians, end values and chord slope of each feature."""
    first, last = F.min_by("offset", "station"), F.max_by("offset", "station")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("station").alias("s_min"), F.max("station").alias("s_max"), F.percentile("station", 0.5).alias("s_median"), F.min("offset").alias("t_min"), F.max("offset").alias("t_max"), F.percentile("offset", 0.5).alias("t_median"), first.alias("t_first"), last.alias("t_last"))
    run = F.col("s_max") - F.col("s_min")
    return out.withColumn("slope", F.when(run > 0, (F.col("t_last") - F.col("t_first")) / run).otherwise(F.lit(0.0)))


def line_fit(rows: DataFrame, keys: list[str], x: str = "station", y: str = "offset") -> DataFrame:
    """Least-squares line and the root mean square of its residuals; slope 0 where all x are equal."""
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) <= 1e-12
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    fit = fit.withColumn("intercept", F.col("_y") - F.col("slope") * F.col("_x")).drop("_x", "_y")
    rms = rows.join(fit, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x), F.lit(2)))).alias("rms"))
    return fit.join(rms, keys)


def trimmed_fit(rows: DataFrame, keys: list[str], share: float, x: str = "station", y: str = "offset") -> DataFrame:
    """The line again without the share of rows that lie farthest from the first."""
    fit = line_fit(rows, keys, x, y).select(*keys, "slope", "intercept")
    far = rows.join(fit, keys).withColumn("_r", F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)))
    far = far.withColumn("_q", F.percentile("_r", 1 - share).over(Window.partitionBy(*keys))).filter("_r <= _q")
    return line_fit(far.select(*keys, x, y), keys, x, y)


def robust_fit(rows: DataFrame, keys: list[str], rounds: int = 5, x: str = "station", y: str = "offset", floor: float = 0.06, ceiling: float = 0.25, least: int = 8) -> DataFrame:
    """A line fitted again and again to the rows whose residual lies within 3 scaled median deviations (between floor and ceiling) of the
    median residual. A round that would leave a key too few rows changes nothing. Rounds are unrolled: one plan, no driver loop over data."""
    w = Window.partitionBy(*keys)
    out = rows.withColumns({"_in": F.lit(True), "_n": F.count(F.lit(1)).over(w)})
    use = lambda c: F.when(F.col("_in"), F.col(c).cast("double"))

    def fitted(d: DataFrame) -> DataFrame:
        d = d.withColumns({"_mx": F.avg(use(x)).over(w), "_my": F.avg(use(y)).over(w)})
        d = d.withColumns({"_xx": F.sum(F.pow(use(x) - F.col("_mx"), F.lit(2))).over(w), "_xy": F.sum((use(x) - F.col("_mx")) * (use(y) - F.col("_my"))).over(w)})
        d = d.withColumn("slope", F.when(F.coalesce("_xx", F.lit(0.0)) <= 1e-12, F.lit(0.0)).otherwise(F.col("_xy") / F.col("_xx")))
        return d.withColumn("_r", F.col(y) - F.col("_my") - F.col("slope") * (F.col(x) - F.col("_mx")))

    for _ in range(rounds):
        out = fitted(out).withColumn("_c", F.percentile(F.when(F.col("_in"), F.col("_r")), 0.5).over(w))
        out = out.withColumn("_d", F.percentile(F.when(F.col("_in"), F.abs(F.col("_r") - F.col("_c"))), 0.5).over(w))
        near = F.col("_in") & (F.abs(F.col("_r") - F.col("_c")) <= F.greatest(F.lit(floor), F.least(F.lit(ceiling), 3 * 1.4826 * F.col("_d"))))
        out = out.withColumn("_next", near).withColumns({"_k": F.sum(F.col("_next").cast("int")).over(w), "_had": F.sum(F.col("_in").cast("int")).over(w)})
        out = out.withColumn("_in", F.when((F.col("_had") >= least) & (F.col("_k") >= F.least(F.lit(least), F.col("_n"))), F.col("_next")).otherwise(F.col("_in")))
    out = fitted(out)
    return out.groupBy(*keys).agg(F.first("slope").alias("slope"), (F.first("_my") - F.first("slope") * F.first("_mx")).alias("intercept"), F.count("*").alias("n"), F.sum(F.col("_in").cast("int")).alias("n_inliers"), F.sqrt(F.avg(F.when(F.col("_in"), F.pow("_r", F.lit(2))))).alias("rms"))


def double_angle(segments: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Mean axis of segments (dx, dy), weighted by length; segments that are too short do not count."""
    length, angle = F.hypot("dx", "dy"), F.atan2("dy", "dx")
    rows = segments.withColumns({"_l": length, "_a": 2 * angle}).filter(F.col("_l") >= least)
    return rows.groupBy(*keys).agg((0.5 * F.atan2(F.sum(F.col("_l") * F.sin("_a")), F.sum(F.col("_l") * F.cos("_a")))).alias("angle"))


def offset_score(points: DataFrame, angles: list[float], size: float, top: int = 8) -> DataFrame:
    """For each angle the sum of the top squared counts of the smoothed histogram of offsets across it: high where points line up."""
    listed = points.select(F.explode(F.array(*map(F.lit, angles))).alias("angle"), "x", "y")
    bins = listed.groupBy("angle", F.floor((F.col("y") * F.cos("angle") - F.col("x") * F.sin("angle")) / size).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("angle").orderBy("bin").rangeBetween(-2, 2)
    sums = bins.withColumn("n", F.sum("n").over(w) / 5)
    best = sums.withColumn("_k", F.row_number().over(Window.partitionBy("angle").orderBy(F.desc("n"), "bin"))).filter(F.col("_k") <= top)
    return best.groupBy("angle").agg(F.sum(F.pow("n", F.lit(2))).alias("score"))


def weighted_bins(rows: DataFrame, keys: list[str], size: float) -> DataFrame:
    """station and offset averaged per bin, weighted by confidence (0.05 at least)."""
    w = F.greatest("confidence", F.lit(0.05))
    low = F.min("station").over(Window.partitionBy(*keys))
    rows = rows.withColumns({"_w": w, "_bin": F.bround((F.col("station") - low) / size).cast("long")})
    return rows.groupBy(*keys, "_bin").agg((F.sum(F.col("_w") * F.col("station")) / F.sum("_w")).alias("station"), (F.sum(F.col("_w") * F.col("offset")) / F.sum("_w")).alias("offset"), F.max("confidence").alias("confidence"), F.count("*").alias("n")).drop("_bin")


def confusion(rows: DataFrame, truth: Column, guess: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts and precision, recall, f1, IoU and accuracy; a denominator of 0 counts as 1."""
    c = rows.select(*(keys or []), truth.alias("t"), guess.alias("g")).groupBy(*(keys or [])).agg(*(F.sum(e.cast("long")).alias(n) for n, e in (("tp", F.expr("t and g")), ("fp", F.expr("not t and g")), ("fn", F.expr("t and not g")), ("tn", F.expr("not t and not g")))))
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "iou": over(tp, tp + fp + fn), "accuracy": over(tp + tn, tp + fp + fn + tn)})


def best_threshold(rows: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """The threshold of the best f1; the first of equals."""
    e = rows.select(F.col(truth).alias("_t"), F.col(score).alias("_s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    all_ = confusion(e, F.col("_t"), F.col("_s") >= F.col("threshold"), ["threshold"])
    return all_.orderBy(F.desc("f1"), "threshold").limit(1)


def cross_entropy(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def roughness(rows: DataFrame, keys: list[str], order: str, z: str) -> DataFrame:
    """Mean, spread and range of z, and the 95th percentile of its steps."""
    step = F.abs(F.col(z) - F.lag(z).over(Window.partitionBy(*keys).orderBy(order)))
    return rows.withColumn("_d", step).groupBy(*keys).agg(F.avg(z).alias("mean"), F.stddev_pop(z).alias("spread"), F.min(z).alias("low"), F.max(z).alias("high"), F.percentile("_d", 0.95).alias("step_p95"))


def displacement(a: DataFrame, b: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Two curves (keys, station, offset) compared on a grid over their common stations: mean and largest distance, and where that is.

    The places of the grid are not written out: between two neighbouring vertices of either curve the distance is straight, so the sum over the places
    there is that of one or, where the curves cross, two arithmetic series, and the largest is at one of its ends. Rows grow with the vertices, not with the places.
    """
    from .ranges import interpolate

    ends = a.groupBy(*keys).agg(F.min("station").alias("a0"), F.max("station").alias("a1")).join(b.groupBy(*keys).agg(F.min("station").alias("b0"), F.max("station").alias("b1")), keys)
    low, high = F.greatest("a0", "b0"), F.least("a1", "b1")
    ends = ends.select(*keys, low.alias("_low"), high.alias("_high")).filter("_low <= _high")
    knots = a.select(*keys, F.col("station").alias("_knot")).unionByName(b.select(*keys, F.col("station").alias("_knot"))).distinct().join(ends, keys).filter(F.col("_knot").between(F.col("_low"), F.col("_high")))
    both = interpolate(interpolate(knots, a.withColumnRenamed("offset", "va"), "_knot", "station", "va", keys), b.withColumnRenamed("offset", "vb"), "_knot", "station", "vb", keys)
    w = Window.partitionBy(*keys).orderBy("_knot")
    both = both.withColumns({"_e": F.col("va") - F.col("vb"), "_k": F.ceil((F.col("_knot") - F.col("_low")) / step)})
    both = both.withColumns({c: F.lead(f"_{c}").over(w) for c in ("knot", "e", "k")})
    # Places first to last lie from this vertex up to the next one, that excluded; the last vertex has its own alone.
    rows = both.withColumns({"_first": F.col("_k"), "_last": F.coalesce(F.col("k") - 1, F.when(F.col("_k") == (F.col("_knot") - F.col("_low")) / step, F.col("_k")))}).filter("_last >= _first")
    at = lambda k: F.col("_low") + k * step
    alone = at(F.col("_first")) == F.col("_knot")
    on = lambda k: F.when(at(k) == F.col("_knot"), F.col("_e")).otherwise(F.col("_e") + (at(k) - F.col("_knot")) / (F.col("knot") - F.col("_knot")) * (F.col("e") - F.col("_e")))
    # Beside a vertex without an offset only a place on the other one has a distance.
    rows = rows.withColumn("_last", F.when(F.col("e").isNull() & F.col("_e").isNotNull() & alone, F.col("_first")).otherwise(F.col("_last")))
    rows = rows.withColumns({"_m": F.col("_last") - F.col("_first") + 1, "_f0": on(F.col("_first")), "_f1": on(F.col("_last"))}).filter("_f0 is not null and _f1 is not null")
    slope = F.when(F.col("_m") > 1, (F.col("_f1") - F.col("_f0")) / (F.col("_m") - 1)).otherwise(0.0)
    turn = F.when(F.col("_f0") * F.col("_f1") < 0, F.least(F.floor(F.abs(F.col("_f0") / slope)) + 1, F.col("_m") - 1)).otherwise(F.col("_m"))  # so many places before the curves cross
    series = lambda n, x, y: n * (F.abs(x) + F.abs(y)) / 2
    rows = rows.withColumn("_t", turn)
    before, after = F.col("_f0") + slope * (F.col("_t") - 1), F.col("_f0") + slope * F.col("_t")
    total = F.when(F.col("_t") == F.col("_m"), series(F.col("_m"), F.col("_f0"), F.col("_f1"))).otherwise(series(F.col("_t"), F.col("_f0"), before) + series(F.col("_m") - F.col("_t"), after, F.col("_f1")))
    edge = lambda f, k: F.struct(F.abs(F.col(f)).alias("d"), (-at(F.col(k))).alias("o"))
    rows = rows.select(*keys, "_m", total.alias("_sum"), F.greatest(edge("_f0", "_first"), edge("_f1", "_last")).alias("_most"))
    return rows.groupBy(*keys).agg((F.sum("_sum") / F.sum("_m")).alias("mean"), F.max("_most").alias("_b")).select(*keys, "mean", F.col("_b.d").alias("most"), (-F.col("_b.o")).alias("at"))


def counts_map(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    c = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def union_all(parts: list[DataFrame], common_only: bool = False) -> DataFrame:
    """All rows; columns that some lack are null there or, with common_only, left out."""
    if common_only:
        names = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        parts = [p.select(*names) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def through_fit(rows: DataFrame, keys: list[str], rounds: int = 4, x: str = "station", y: str = "offset", floor: float = 1.25, share: float = 0.75, times: float = 2.5, least: float = 0.45) -> DataFrame:
    """A line per key through most of its rows: slope, intercept, n, n_kept, residual (the median of kept rows). Each round fits the rows kept
    so far and keeps all whose residual is at most `times` the `share` quantile of theirs (`floor` at least), as long as that leaves two rows
    and the share `least` of all. One place fits no slope: 0, through the mean.

    What a round hands on is a row per key, so rows are never brought together by key: sums are made part by part, in four passes a round.
    """
    residual = lambda a, b: F.abs(F.col(y) - F.col(a) * F.col(x) - F.col(b))
    begun = {"_a": 0.0, "_b": 0.0, "_cut": float("inf"), "_slope": 0.0, "_base": 0.0}
    state = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumns({c: F.lit(v) for c, v in begun.items()}), "state")
    for _ in range(rounds):
        kept = rows.join(state, keys).filter(residual("_a", "_b") <= F.col("_cut")).select(*keys, x, y)
        slope, base = F.coalesce(F.regr_slope(y, x), F.lit(0.0)), F.coalesce(F.regr_intercept(y, x), F.avg(y))
        fit = stored(kept.groupBy(*keys).agg(slope.alias("slope"), base.alias("intercept")), "fit")
        wide = kept.join(fit, keys).groupBy(*keys).agg((F.percentile(residual("slope", "intercept"), share) * times).alias("_q"))
        cut = stored(fit.join(wide, keys).select(*keys, "slope", "intercept", F.greatest(F.lit(floor), "_q").alias("_new")), "cut")
        many = rows.join(cut, keys).filter(residual("slope", "intercept") <= F.col("_new")).groupBy(*keys).agg(F.count("*").alias("_many"))
        good = F.coalesce("_many", F.lit(0)) >= F.greatest(F.lit(2), F.floor(F.col("n") * least))
        chosen = {a: F.when(good, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("_a", "slope"), ("_b", "intercept"), ("_cut", "_new"))}
        next_ = state.join(cut, keys).join(many, keys, "left").select(*keys, "n", *chosen.values(), F.col("slope").alias("_slope"), F.col("intercept").alias("_base"))
        old, state = state, stored(next_, "state")
        discard(old, fit, cut)
    found = rows.join(state, keys).filter(residual("_a", "_b") <= F.col("_cut"))
    out = found.groupBy(*keys, "_slope", "_base", "n").agg(F.count("*").alias("n_kept"), F.percentile(residual("_slope", "_base"), 0.5).alias("residual"))
    return out.select(*keys, F.col("_slope").alias("slope"), F.col("_base").alias("intercept"), "n", "n_kept", "residual")
