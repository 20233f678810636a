"""Centrelines of track bands beside a guide: where evidence carries a band, and the straight line through it there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Guide
from .aggregates import robust_fit
from .lines import on_guide, stations_between
from .ranges import points_in_intervals

#: How far beyond a band's half width its evidence may lie.
BEYOND = 0.65


@dataclass(frozen=True)
class Band:
    """A band of offsets. A whole band runs along all of the guide, with or without evidence, and lies on it where there is none."""

    name: str
    centre: float
    half_width: float
    role: str = ""
    whole: bool = False


@dataclass(frozen=True)
class Bridge:
    """A stretch in which gaps of a band up to `most` are bridged, as a reviewer said."""

    band: str
    low: float
    high: float
    most: float
    note: str


def intervals(features: DataFrame, keys: list[str], gap: float, bridges: tuple[Bridge, ...] = ()) -> DataFrame:
    """Features (keys, band_id, low, high) joined per band where the next starts within `gap` of the farthest end so far, or where a bridge holds the
    whole gap: start, end, n, n_bridged (gaps longer than `gap`), longest (the longest of those, else 0), middle (its middle, the last of equals, else
    0) and note (of the last bridge, else null). Ends may come in either order; a feature without a band or an end does not count."""
    own = [*keys, "band_id"]
    rows = features.filter("band_id is not null and low is not null and high is not null")
    rows = rows.select(*own, F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
    w = Window.partitionBy(*own).orderBy("low", "high")
    before, gone = F.col("_before"), F.col("low") - F.col("_before")
    note = F.lit(None).cast("string")
    for b in reversed(bridges):  # the first that holds the gap counts
        note = F.when((F.col("band_id") == b.band) & (gone > 0) & (gone <= b.most) & (before >= b.low) & (F.col("low") <= b.high), F.lit(b.note)).otherwise(note)
    rows = rows.withColumn("_before", F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_note", F.when(gone > gap, note))
    cut = F.when(before.isNull() | ((gone > gap) & F.col("_note").isNull()), 1).otherwise(0)
    rows = rows.withColumn("_cut", cut).withColumn("_group", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bridged = F.when((F.col("_cut") == 0) & F.col("_note").isNotNull(), F.struct(gone.alias("gap"), F.col("low").alias("at"), ((before + F.col("low")) / 2).alias("middle"), F.col("_note").alias("note")))
    out = rows.withColumn("_bridged", bridged).groupBy(*own, "_group").agg(F.min("low").alias("start"), F.max("high").alias("end"), F.count("*").alias("n"), F.count("_bridged").alias("n_bridged"), F.max("_bridged").alias("_b"), F.max_by("_bridged.note", F.when(F.col("_bridged").isNotNull(), F.col("low"))).alias("note"))
    zero = F.lit(0.0)
    return out.select(*own, "start", "end", "n", "n_bridged", F.coalesce("_b.gap", zero).alias("longest"), F.coalesce("_b.middle", zero).alias("middle"), "note")


def fits(features: DataFrame, vertices: DataFrame, guide: Guide, bands: list[Band], keys: list[str], gap: float, least: float, bridges: tuple[Bridge, ...] = ()) -> DataFrame:
    """One row per interval of a band that is at least `least` long, numbered from 0: the straight line offset = intercept + slope * station through
    the vertices (keys, band_id, x, y) of the band's evidence there, without those that lie far from it; n_samples, n_inliers and rms.

    Vertices count within the guide and near the band. An interval with fewer than two of them has slope 0 and the median offset of all the band's
    vertices; without any, that of the features (keys, band_id, low, high, offset), else the band's centre (0 for a whole band). Where all stand at
    one station the line is their mean. Whole bands have one row for each key of the features. A fit brings one interval's vertices together, no
    more: a band's other intervals go to other tasks."""
    own = [*keys, "band_id"]
    known = F.create_map(*(F.lit(x) for b in bands for x in (b.name, float(b.centre))))
    width = F.create_map(*(F.lit(x) for b in bands for x in (b.name, b.half_width + BEYOND)))
    whole = F.col("band_id").isin([b.name for b in bands if b.whole])
    station, offset = guide.project(F.col("x"), F.col("y"))
    samples = vertices.filter(F.col("band_id").isin([b.name for b in bands])).select(*own, station.alias("station"), offset.alias("offset"))
    samples = samples.filter(F.col("station").between(0.0, guide.length) & (F.abs(F.col("offset") - known[F.col("band_id")]) <= width[F.col("band_id")]))
    features = features.filter(F.col("band_id").isin([b.name for b in bands]))

    parts = intervals(features.filter(~whole), keys, gap, bridges).filter(F.col("end") - F.col("start") >= least)
    along = [b.name for b in bands if b.whole]
    if along:
        n = features.groupBy(*keys).agg(*(F.count(F.when(F.col("band_id") == b, 1)).alias(f"_{k}") for k, b in enumerate(along)))
        every = n.select(*keys, F.explode(F.array(*(F.struct(F.lit(b).alias("band_id"), F.col(f"_{k}").alias("n")) for k, b in enumerate(along)))).alias("_e"))
        every = every.select(*keys, "_e.band_id", F.lit(0.0).alias("start"), F.lit(float(guide.length)).alias("end"), "_e.n", F.lit(0).cast("long").alias("n_bridged"), F.lit(0.0).alias("longest"), F.lit(0.0).alias("middle"), F.lit(None).cast("string").alias("note"))
        parts = parts.unionByName(every)
    parts = parts.filter(F.col("end") > F.col("start"))
    parts = parts.withColumn("interval_id", F.row_number().over(Window.partitionBy(*own).orderBy("start")) - 1)

    usual = samples.groupBy(*own).agg(F.percentile("offset", 0.5).alias("_usual"))
    seen = features.groupBy(*own).agg(F.percentile("offset", 0.5).alias("_seen"))
    inside = points_in_intervals(samples, parts.select(*own, "interval_id", "start", "end"), "station", "start", "end", max(least, gap, guide.length / 64), own)
    fit = robust_fit(inside.select(*own, "interval_id", "station", "offset"), [*own, "interval_id"]).withColumnRenamed("n", "n_samples")
    out = parts.join(fit, [*own, "interval_id"], "left").join(usual, own, "left").join(seen, own, "left")
    default = F.when(whole, F.lit(0.0)).otherwise(F.coalesce("_usual", "_seen", known[F.col("band_id")]))
    fitted = F.coalesce("n_samples", F.lit(0)) >= 2
    role = F.create_map(*(F.lit(x) for b in bands for x in (b.name, b.role)))
    values = {
        "intercept": F.when(fitted, F.col("intercept")).otherwise(default),
        "slope": F.when(fitted, F.col("slope")).otherwise(0.0),
        "n_samples": F.coalesce("n_samples", F.lit(0)),
        "n_inliers": F.when(fitted, F.col("n_inliers")).otherwise(0),
        "rms": F.when(fitted, F.col("rms")).otherwise(0.0),
        "role": role[F.col("band_id")],
    }
    return out.withColumns(values).drop("_usual", "_seen")


def centrelines(found: DataFrame, guide: Guide, step: float) -> DataFrame:
    """The lines of `fits`, sampled evenly at most `step` apart, both ends included: keys, band_id, interval_id, k, station, offset, x, y."""
    rows = stations_between(found, step).withColumn("offset", F.col("intercept") + F.col("slope") * F.col("station"))
    return on_guide(rows, guide, F.col("offset"))
