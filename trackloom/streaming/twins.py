"""Streaming twins of the batch operators: the same columns over readStream, with watermarks, so state is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_counts(points: DataFrame, time: str, late: str, window: str, value: str, size: float) -> DataFrame:
    """Histogram of a value per time window; rows later than the watermark do not count."""
    return points.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.floor(F.col(value) / size).alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def windowed_ground(points: DataFrame, time: str, late: str, window: str, cell: float) -> DataFrame:
    """Lowest height per cell and window: a ground that needs no sorted state."""
    keys = [F.window(time, window).alias("w"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")]
    return points.withWatermark(time, late).groupBy(*keys).agg(F.min("z").alias("ground"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "gx", "gy", "ground", "n")


def sessions(points: DataFrame, time: str, late: str, key: str, gap: str) -> DataFrame:
    """Islands in time: session windows of each key."""
    return points.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_ids(rows: DataFrame, time: str, late: str, key: str) -> DataFrame:
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
