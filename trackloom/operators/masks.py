"""Masks as tables of the pixels that are set (image, row, col): components in two levels, the largest, small ones removed, opening and closing.

A mask is cut into square tiles. Within a tile a kernel joins runs of set pixels row by row; across tiles only pixels along the borders are
compared, so the edges that the components are built from grow with the length of the borders, not with the pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_runs
from .graph import components

#: Rows and columns of a tile.
TILE = 256
#: Bits of a row and of a column in a pixel's number; an image has the rest.
_BITS = 20


def _number():
    row, col, image = F.col("row"), F.col("col"), F.col("image")
    most = 1 << _BITS
    right = row.between(0, most - 1) & col.between(0, most - 1) & image.between(0, (1 << (62 - 2 * _BITS)) - 1)
    code = F.shiftleft(image.cast("long"), 2 * _BITS) + F.shiftleft(row.cast("long"), _BITS) + col
    return F.when(right, code).otherwise(F.raise_error(F.lit(f"rows and columns are from 0 to {most - 1}, images from 0 on")).cast("long"))


def _roots(row: np.ndarray, col: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each of a tile's pixels, sorted by row and column, the place of the first pixel of its component."""
    begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)))
    ends = np.append(begins[1:], len(row))
    r, a, b = row[begins].tolist(), col[begins].tolist(), col[ends - 1].tolist()
    top, reach = list(range(len(r))), int(diagonal)

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    above = 0  # the first run that may still touch a run of this row or later
    for k in range(len(r)):
        while above < k and (r[above] < r[k] - 1 or r[above] == r[k] - 1 and b[above] < a[k] - reach):
            above += 1
        j = above
        while j < k and r[j] == r[k] - 1 and a[j] <= b[k] + reach:
            if b[j] >= a[k] - reach:
                x, y = root(j), root(k)
                top[max(x, y)] = min(x, y)
            j += 1
    return np.repeat(begins[[root(k) for k in range(len(r))]], ends - begins)


def mask_components(pixels: DataFrame, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """image, row, col, component of set pixels (image, row, col): the number of the first pixel of each component, by image, row and column.

    Pixels touch at their sides, and at their corners too if `diagonal`. Repeated pixels count once, those with a null are left out.
    """
    rows = pixels.select(*(F.col(c).cast("long") for c in ("image", "row", "col"))).dropna().distinct()
    rows = rows.withColumns({"number": _number(), "_r": F.floor(F.col("row") / tile), "_c": F.floor(F.col("col") / tile)})

    def run(batch, starts):
        row, col, number = (np.asarray(batch.column(c)) for c in ("row", "col", "number"))
        local = [number[a:b][_roots(row[a:b], col[a:b], diagonal)] for a, b in zip(starts, starts[1:], strict=False)]
        return batch.select(["image", "row", "col"]).append_column("local", pa.array(np.concatenate(local)))

    from ..storage import stored

    cut = map_runs(rows.select("image", "_r", "_c", "row", "col", "number"), ["image", "_r", "_c"], ["row", "col"], run, "image long, row long, col long, local long")
    cut = stored(cut, "tiles")
    down, right = F.col("row") % tile == tile - 1, F.col("col") % tile == tile - 1
    to = lambda dr, dc, when: F.when(when, F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")))
    over = [to(1, 0, down), to(0, 1, right)] + ([to(1, -1, down | (F.col("col") % tile == 0)), to(1, 1, down | right)] if diagonal else [])
    left = cut.filter(down | right | (F.col("col") % tile == 0)).select("image", F.col("local").alias("a"), F.explode(F.array_compact(F.array(*over))).alias("p")).select("image", "a", "p.row", "p.col")
    edge = cut.filter((F.col("row") % tile == 0) | (F.col("col") % tile).isin(0, tile - 1)).select("image", "row", "col", F.col("local").alias("b"))
    joined = components(left.join(edge, ["image", "row", "col"]).filter("a <> b").select("a", "b").distinct())
    named = cut.join(joined.withColumnRenamed("node", "local"), "local", "left")
    return named.select("image", "row", "col", F.coalesce("component", "local").alias("component"))


def sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("image", "component").agg(F.count("*").alias("n"))


def largest(found: DataFrame) -> DataFrame:
    """The pixels of each image's largest component, the first of equal ones."""
    best = sizes(found).groupBy("image").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return found.join(best, ["image", "component"], "left_semi")


def without_small(found: DataFrame, least: int) -> DataFrame:
    """The pixels of components of `least` pixels or more."""
    return found.join(sizes(found).filter(F.col("n") >= least).select("image", "component"), ["image", "component"], "left_semi")


def crowded(pixels: DataFrame, reach: int, least: int, tile: int = TILE) -> DataFrame:
    """Every pixel, set or not, with `least` set ones or more in the square around it. Repeated pixels count once, those with a null are left out.

    Set pixels go to the tiles that they reach, and a kernel counts within a tile by sums over rectangles; no pixel is written out for the squares it lies in.
    """
    rows = pixels.select("image", "row", "col").dropna()
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    rows = rows.select("image", F.col("row").cast("long"), F.col("col").cast("long")).withColumn("_r", near("row")).withColumn("_c", near("col"))
    side = 2 * reach + 1

    def run(batch, starts):
        row, col, top, left = (np.asarray(batch.column(c)) for c in ("row", "col", "_r", "_c"))
        taken, down, across = [], [], []
        for a, b in zip(starts, starts[1:], strict=False):
            r0, c0 = row[a:b].min() - 2 * reach, col[a:b].min() - 2 * reach
            count = np.zeros((row[a:b].max() - r0 + 2 + 2 * reach, col[a:b].max() - c0 + 2 + 2 * reach), np.int32)
            count[row[a:b] - r0 + 1, col[a:b] - c0 + 1] = 1
            count = count.cumsum(axis=0).cumsum(axis=1)
            r, c = np.nonzero(count[side:, side:] - count[:-side, side:] - count[side:, :-side] + count[:-side, :-side] >= least)
            r, c = r + r0 + reach, c + c0 + reach
            inside = (r // tile == top[a]) & (c // tile == left[a])
            down.append(r[inside])
            across.append(c[inside])
            taken.append(np.full(len(down[-1]), a))
        return pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(np.concatenate(taken))), pa.array(np.concatenate(down)), pa.array(np.concatenate(across))], names=["image", "row", "col"])

    kind = pixels.schema["image"].dataType.simpleString()
    found = map_runs(rows.select("image", "_r", "_c", "row", "col"), ["image", "_r", "_c"], [], run, f"image {kind}, row long, col long")
    return found.select("image", *(F.col(c).cast(pixels.schema[c].dataType) for c in ("row", "col")))


def dilated(pixels: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """Every pixel of the image with a set one in the square around it."""
    return crowded(pixels, reach, 1).filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def eroded(pixels: DataFrame, reach: int) -> DataFrame:
    """Every pixel whose square is set as a whole; what lies outside the image is not set."""
    return crowded(pixels, reach, (2 * reach + 1) ** 2)


def opened(pixels: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    return dilated(eroded(pixels, reach), reach, height, width)


def closed(pixels: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    return eroded(dilated(pixels, reach, height, width), reach)
