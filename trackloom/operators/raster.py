"""Rasters as pixel tables (tile_id, row, col, value): mosaics, neighbourhoods, resampling, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Affine


def tiles(width: int, height: int, tile: int, stride: int, spark) -> DataFrame:
    """row_off, col_off of the tiles over an image; the last of each row and column is flush with the edge."""
    def starts(n: int):
        last = max(n - tile, 0)
        return F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(last), F.lit(stride)), F.array(F.lit(last)))) if last else F.array(F.lit(0))

    return spark.range(1).select(F.explode(starts(height)).alias("row_off"), F.lit(0).alias("_")).select("row_off", F.explode(starts(width)).alias("col_off"))


def mosaic(pixels: DataFrame) -> DataFrame:
    """The mean of overlapping tiles (row, col in the mosaic, value), as bytes, half to even."""
    return pixels.groupBy("row", "col").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).withColumn("byte", F.bround(F.least(F.greatest(F.col("mean"), F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def placed(tile_pixels: DataFrame, tiles_: DataFrame) -> DataFrame:
    """Tile pixels at their place in the whole image."""
    return tile_pixels.join(tiles_.select("tile_id", "row_off", "col_off"), "tile_id").withColumns({"row": F.col("row") + F.col("row_off"), "col": F.col("col") + F.col("col_off")}).drop("row_off", "col_off")


def around(points: DataFrame, pixels: DataFrame, reach: int, threshold: float) -> DataFrame:
    """Per point (point_id, row, col): most, mean and share over a threshold of the pixels around it."""
    near = points.withColumn("_r", F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach))).withColumn("_c", F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach)))
    met = near.join(pixels.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"], "left")
    return met.groupBy("point_id").agg(F.max("value").alias("most"), F.avg("value").alias("mean"), F.avg((F.col("value") >= threshold).cast("double")).alias("share"))


def bilinear(points: DataFrame, pixels: DataFrame, inverse: Affine) -> DataFrame:
    """Value at each point (point_id, x, y) from the four pixels around it; 0 without all four."""
    col, row = inverse.apply(F.col("x"), F.col("y"))
    rows = points.withColumns({"_c": col - 0.5, "_r": row - 0.5}).withColumns({"_c0": F.floor("_c"), "_r0": F.floor("_r")})
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    rows = rows.withColumn("_k", corner).withColumns({"row": F.col("_r0") + F.col("_k.i"), "col": F.col("_c0") + F.col("_k.j")})
    u, v = F.col("_c") - F.col("_c0"), F.col("_r") - F.col("_r0")
    weight = F.when(F.col("_k.i") == 1, v).otherwise(1 - v) * F.when(F.col("_k.j") == 1, u).otherwise(1 - u)
    met = rows.withColumn("_w", weight).join(pixels.select("row", "col", "value"), ["row", "col"], "left")
    return met.groupBy("point_id").agg(F.when(F.count("value") == 4, F.sum(F.col("_w") * F.col("value"))).otherwise(F.lit(0.0)).alias("value"))


def sampled_dsm(points: DataFrame, pixels: DataFrame, inverse: Affine, nodata: float | None = None) -> DataFrame:
    """The pixel at each point; null for no data."""
    col, row = inverse.apply(F.col("x"), F.col("y"))
    rows = points.withColumns({"row": F.floor(row), "col": F.floor(col)}).join(pixels.select("row", "col", "value"), ["row", "col"], "left")
    return rows.withColumn("value", F.when(F.col("value") != nodata, F.col("value")) if nodata is not None else F.col("value"))


def resampled(pixels: DataFrame, window: DataFrame, to_world: Affine, source_inverse: Affine) -> DataFrame:
    """Nearest source pixel of each pixel (row, col) of another grid."""
    x, y = to_world.apply(F.col("col") + 0.5, F.col("row") + 0.5)
    rows = window.withColumns({"_x": x, "_y": y})
    sc, sr = source_inverse.apply(F.col("_x"), F.col("_y"))
    rows = rows.withColumns({"_sr": F.floor(sr), "_sc": F.floor(sc)}).drop("_x", "_y")
    return rows.join(pixels.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value"), ["_sr", "_sc"], "left").drop("_sr", "_sc")


def features(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Local contrast of pixels (row, col, r, g, b): brightness, channel spread, Sobel gradient, spread of 9 x 9, and a long thin mean over a short thick one.
    A neighbourhood is gathered by shifting pixels to the places they count for, so only neighbours meet."""
    base = pixels.withColumn("grey", (F.col("r") + F.col("g") + F.col("b")) / 3)
    shift = base.select(*keys, F.explode(F.sequence(F.col("row") - 8, F.col("row") + 8)).alias("_r"), "row", "col", "grey")
    shift = shift.select(*keys, "_r", "row", "col", "grey", F.explode(F.sequence(F.col("col") - 4, F.col("col") + 4)).alias("_c"))
    dr, dc, g = F.col("row") - F.col("_r"), F.col("col") - F.col("_c"), F.col("grey")
    sobel_x = F.sum(F.when((F.abs(dr) <= 1) & (F.abs(dc) == 1), g * dc * (2 - F.abs(dr))))
    sobel_y = F.sum(F.when((F.abs(dc) <= 1) & (F.abs(dr) == 1), g * dr * (2 - F.abs(dc))))
    square = F.stddev_pop(F.when(F.abs(dr) <= 4, g))
    thin = F.avg(F.when(dc == 0, g)) - F.avg(F.when((dr == 0) & (F.abs(dc) <= 1), g))
    out = shift.groupBy(*keys, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(sobel_x.alias("sobel_x"), sobel_y.alias("sobel_y"), square.alias("spread"), thin.alias("line"))
    return base.join(out, [*keys, "row", "col"])


def tile_validity(pixels: DataFrame, least: float, signal: float = 0.0) -> DataFrame:
    """Tiles whose share of pixels with a signal is enough."""
    return pixels.groupBy("tile_id").agg(F.avg((F.col("value") > signal).cast("double")).alias("valid_ratio")).filter(F.col("valid_ratio") >= least)


def overlap_average(scored: DataFrame) -> DataFrame:
    """Tiled inference put together: sums over weights, per pixel."""
    return scored.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def row_peaks(pixels: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Runs of pixels over a threshold along each row: their weighted centre and mean value."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    on = pixels.filter(F.col("value") >= least)
    cut = F.when(F.col("col") - F.lag("col").over(w) > 1, 1).otherwise(0)
    runs = on.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "row", "_run").agg((F.sum(F.col("col") * F.col("value")) / F.sum("value")).alias("x"), F.avg("value").alias("score"), F.count("*").alias("width")).drop("_run")
