"""Joins on ranges and nearness. A theta condition alone would plan a nested loop over all pairs; here rows are dealt into
cells first, so that every join has an equality to shuffle on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.geometry import segment_crossing, segment_distance
from ..shipping import map_arrow
from ..storage import stored

#: Pairs that one task of a join by cells compares, about. It steers costs, not results.
PAIRS = 4_000_000
#: Cells around segments that a task looks at at once, and occupied cells that are broadcast at most (8 MB).
SPOTS, FEW = 1 << 20, 1_000_000
#: Cells of points by whose broadcast targets are looked up at most, about 16 MB.
LOOKED_UP = 400_000


def cells(low: Column, high: Column, size: float) -> Column:
    """The cells of a length that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(F.greatest(low, high) / size))


def dealt(df: DataFrame) -> DataFrame:
    """A side whose rows were multiplied, by cells or along a sequence. Spark's estimate of its size leaves that out, so it is kept from being broadcast."""
    return df if df.isStreaming else df.hint("merge")


def met(a: DataFrame, b: DataFrame, cells: list[str]) -> DataFrame:
    """a joined with b by cells. Pairs are counted first; where there are many, a cell of many is cut into pieces of a's rows, each with all of b's, and
    the pieces are dealt to so many tasks that none compares many more than PAIRS."""
    if a.isStreaming or b.isStreaming:
        return a.join(b, cells)
    many = a.groupBy(*cells).agg(F.count("*").alias("_n")).join(b.groupBy(*cells).agg(F.count("*").alias("_m")), cells).select(*cells, (F.col("_n") * F.col("_m")).alias("_pairs"))
    pairs = many.agg(F.sum("_pairs")).first()[0] or 0
    if pairs <= 2 * PAIRS:
        return a.join(dealt(b), cells)
    tasks = min(20_000, -(-pairs // PAIRS))
    # Cells of more than PAIRS pairs: no more than there are tasks.
    cut = F.broadcast(stored(many.filter(F.col("_pairs") > PAIRS).select(*cells, F.ceil(F.col("_pairs") / PAIRS).cast("int").alias("_cut")), "cuts"))
    of = F.coalesce("_cut", F.lit(1))
    left = a.join(cut, cells, "left").withColumn("_piece", F.pmod(F.xxhash64(*a.columns), of).cast("int")).drop("_cut")
    # Dealt first: what a small table's few tasks would multiply, many do.
    right = b.repartition(min(tasks, 200), *cells).join(cut, cells, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), of - 1))).drop("_cut")
    by = [*cells, "_piece"]
    return left.repartition(tasks, *by).join(dealt(right.repartition(tasks, *by)), by).drop("_piece")


def widening(points: DataFrame, keys: list[str], first: float, radius: float, find) -> DataFrame:
    """What `find(points, r)` finds within r of each key, one row of it: first within a small radius, then, for the keys without, within twice that, up to the
    radius. What is nearest within a small radius is nearest in all, so the rows are those of `find(points, radius)`, and few points see many targets."""
    found, left, r = None, points, first
    while True:
        now = find(left, min(r, radius))
        if r >= radius:
            return now if found is None else found.unionByName(now)
        now = stored(now, "near")
        done = now.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        left = stored(left.join(done, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti"), "left")
        found = now if found is None else found.unionByName(now)
        if not left.limit(1).count():
            return found
        r *= 2


def first_radius(targets: DataFrame, radius: float, x: str, y: str, few: int = 2) -> float:
    """The radius, halved until cells of that size hold few targets in the mean. It steers costs, not results."""
    sizes = [radius / 2**k for k in range(17)]
    r = targets.agg(F.count("*"), *(F.approx_count_distinct(F.struct(F.floor(F.col(x) / s), F.floor(F.col(y) / s)), 0.1) for s in sizes)).first()
    return next((s for s, n in zip(sizes, r[1:], strict=True) if r[0] <= few * n), sizes[-1])


def interval_join(left: DataFrame, right: DataFrame, low: tuple[str, str], high: tuple[str, str], size: float, on: list[str] | None = None) -> DataFrame:
    """Rows whose intervals overlap (ends included): left low[0]..high[0] with right low[1]..high[1]. Column names must differ
    but for `on`. Each pair is kept in the first cell that both touch."""
    a = left.withColumn("_cell", F.explode(cells(F.col(low[0]), F.col(high[0]), size)))
    b = right.withColumn("_cell", F.explode(cells(F.col(low[1]), F.col(high[1]), size)))
    both = dealt(a).join(dealt(b), [*(on or []), "_cell"]).filter((F.col(low[0]) <= F.col(high[1])) & (F.col(low[1]) <= F.col(high[0])))
    return both.filter(F.col("_cell") == F.floor(F.greatest(F.col(low[0]), F.col(low[1])) / size)).drop("_cell")


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, size: float, on: list[str] | None = None) -> DataFrame:
    """Points with each interval that holds them, ends included."""
    a = points.withColumn("_cell", F.floor(F.col(at) / size))
    b = intervals.withColumn("_cell", F.explode(cells(F.col(low), F.col(high), size)))
    return a.join(dealt(b), [*(on or []), "_cell"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def near_points(points: DataFrame, targets: DataFrame, radius: float, x: str = "x", y: str = "y", tx: str = "tx", ty: str = "ty", occupied: bool = False) -> DataFrame:
    """Pairs within a radius, with their distance. Targets are dealt to the nine cells around them; points to their own. With `occupied`, for no more points than
    targets, points are dealt to the cells of twice the radius that they may see, about four, and only targets in these go to tasks."""
    if occupied:
        size, wide = 2 * radius, radius * (1 + 1e-9)
        a = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
        for c, cell in ((x, "_cx"), (y, "_cy")):
            a = a.withColumn(cell, F.explode(cells(F.col(c) - wide, F.col(c) + wide, size)))
        b = targets.withColumns({"_cx": F.floor(F.col(tx) / size), "_cy": F.floor(F.col(ty) / size)})
        some = a.select("_cx", "_cy").distinct()
        if some.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
            b = b.join(F.broadcast(some), ["_cx", "_cy"], "left_semi")
    else:
        a = points.withColumns({"_cx": F.floor(F.col(x) / radius), "_cy": F.floor(F.col(y) / radius)})
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        b = targets.withColumn("_d", F.explode(around)).withColumns({"_cx": F.floor(F.col(tx) / radius) + F.col("_d.i"), "_cy": F.floor(F.col(ty) / radius) + F.col("_d.j")}).drop("_d")
    return met(a, b, ["_cx", "_cy"]).withColumn("distance", F.hypot(F.col(x) - F.col(tx), F.col(y) - F.col(ty))).filter(F.col("distance") <= radius).drop("_cx", "_cy")


def nearest(points: DataFrame, targets: DataFrame, radius: float, key: str, target_key: str, x: str = "x", y: str = "y", tx: str = "tx", ty: str = "ty") -> DataFrame:
    """key, its nearest target within the radius and the distance; ties go to the smaller target. Of targets at one place only the smallest can be it;
    points look within a small radius first, and farther where nothing is found."""
    places = targets.groupBy(tx, ty).agg(F.min(target_key).alias(target_key))

    def find(left, r):
        found = near_points(left, places, r, x, y, tx, ty)
        return found.groupBy(key).agg(F.min(F.struct("distance", target_key)).alias("_n")).select(key, F.col(f"_n.{target_key}").alias(target_key), F.col("_n.distance").alias("distance"))

    if points.isStreaming or targets.isStreaming:
        return find(points, radius)
    return widening(points, [key], first_radius(places, radius, tx, ty), radius, find)


def near_segments(points: DataFrame, segments: DataFrame, radius: float, occupied: bool = False) -> DataFrame:
    """Points (x, y) with each segment (ax, ay, bx, by) within the radius, the distance and the share along the segment. With `occupied`, for few points, the
    cells of the points are looked up before segments are dealt to tasks."""
    a = points.withColumns({"_cx": F.floor(F.col("x") / radius), "_cy": F.floor(F.col("y") / radius)})
    # A segment goes to the cells along it, not to all of its bounding box: per column of cells, the rows between its heights there.
    wide = radius * (1 + 1e-9)  # a distance that is rounded to the radius counts
    b = None
    if occupied:
        some = a.select("_cx", "_cy").distinct()
        b = _along(segments, some, radius, wide)
        b = b if b is None else stored(b, "along")
    if b is None:
        b = segments.withColumn("_cx", F.explode(cells(F.least("ax", "bx") - wide, F.greatest("ax", "bx") + wide, radius)))
        run = F.col("bx") - F.col("ax")
        clip = lambda u: F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
        u0, u1 = (F.when(run == 0, F.lit(float(k))).otherwise(clip(F.try_divide((F.col("_cx") + 2 * k) * radius + (-radius if k == 0 else 0.0) - F.col("ax"), run))) for k in (0, 1))
        y0, y1 = (F.col("ay") + u * (F.col("by") - F.col("ay")) for u in (u0, u1))
        b = b.withColumn("_cy", F.explode(cells(F.least(y0, y1) - wide, F.greatest(y0, y1) + wide, radius)))
        if occupied:
            b = b.join(some, ["_cx", "_cy"], "left_semi")
    distance, share = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return met(a, b, ["_cx", "_cy"]).withColumns({"distance": distance, "share": share}).filter(F.col("distance") <= radius).drop("_cx", "_cy")


def columns_of(ends: np.ndarray, size: float, wide: float) -> tuple[np.ndarray, ...]:
    """The cells of a size that places within `wide` of segments (rows ax, ay, bx, by) lie in, by columns: number of the segment, cell x, first and last cell y."""
    ax, ay, bx, by = ends
    run, rise = bx - ax, by - ay
    low = np.floor((np.minimum(ax, bx) - wide) / size)
    many = (np.floor((np.maximum(ax, bx) + wide) / size) - low).astype(np.int64) + 1
    of = np.repeat(np.arange(len(ax)), many)
    sx = np.repeat(low, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    flat = np.where(run == 0, 1.0, run)
    heights = [np.where(run[of] == 0, (ay, by)[k][of], ay[of] + np.clip((x - ax[of]) / flat[of], 0.0, 1.0) * rise[of]) for k, x in enumerate((sx * size - wide, (sx + 1) * size + wide))]
    return of, sx, np.floor((np.minimum(*heights) - wide) / size), np.floor((np.maximum(*heights) + wide) / size)


def in_blocks(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows that become so many rows each, of about SPOTS in all."""
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(many) // SPOTS)) + 1, len(many))
    return zip([0, *cuts[:-1]], cuts, strict=True)


def spots(ends: np.ndarray, size: float, wide: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The cells of a size whose middle lies within `wide` of segments, some at a time: number of the segment, cell x, cell y and distance."""
    ax, ay, bx, by = ends
    of, sx, low, high = columns_of(ends, size, wide)
    many = (high - low).astype(np.int64) + 1
    for p, q in in_blocks(many):
        n = many[p:q]
        k, x = np.repeat(of[p:q], n), np.repeat(sx[p:q], n)
        y = np.repeat(low[p:q] - (np.cumsum(n) - n), n) + np.arange(len(k))
        dx, dy = (bx - ax)[k], (by - ay)[k]
        px, py = (x + 0.5) * size - ax[k], (y + 0.5) * size - ay[k]
        length = dx * dx + dy * dy
        u = np.clip((px * dx + py * dy) / np.where(length == 0, 1.0, length), 0.0, 1.0)
        d = np.sqrt((px - u * dx) ** 2 + (py - u * dy) ** 2)
        near = np.flatnonzero(d <= wide)
        yield k[near], x[near].astype(np.int64), y[near].astype(np.int64), d[near]


def _along(segments: DataFrame, some: DataFrame, radius: float, wide: float) -> DataFrame | None:
    """Segments with the cells (_cx, _cy) along them, of `some` cells only. These are broadcast, and a segment looks up a column of cells at a time, however long it
    is; None where they are too many."""
    some = some.dropna().limit(FEW + 1).toArrow()
    x, y = (some.column(c).to_numpy() for c in ("_cx", "_cy"))
    if not 0 < len(x) <= FEW or (int(x.max()) - int(x.min()) + 1) * (int(y.max()) - int(y.min()) + 3) >= 2**52:
        return None
    x0, x1, y0, y1 = int(x.min()), int(x.max()), int(y.min()), int(y.max())
    tall = y1 - y0 + 3  # with a row below and one above, for what lies beyond
    sent = segments.sparkSession.sparkContext.broadcast(np.sort((x - x0) * tall + (y - y0 + 1)))
    at = [segments.columns.index(c) for c in ("ax", "ay", "bx", "by")]

    def run(batches):
        keys = sent.value
        for batch in batches:
            ends = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in at])
            good = np.flatnonzero(np.isfinite(ends).all(axis=0))
            of, cx, low, high = columns_of(ends[:, good], radius, wide)
            on = (cx >= x0) & (cx <= x1) & (high >= y0) & (low <= y1)
            of, cx, low, high = of[on], cx[on], np.maximum(low[on], y0), np.minimum(high[on], y1)
            first = np.searchsorted(keys, (cx - x0) * tall + (low - y0 + 1))
            many = np.searchsorted(keys, (cx - x0) * tall + (high - y0 + 1), "right") - first
            for p, q in in_blocks(many):
                n = many[p:q]
                key = keys[np.repeat(first[p:q] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                rows = batch.take(pa.array(good[np.repeat(of[p:q], n)]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key // tall + x0), pa.array(key % tall + y0 - 1)], [*batch.schema.names, "_cx", "_cy"])

    return map_arrow(segments, run, StructType([*segments.schema.fields, StructField("_cx", LongType()), StructField("_cy", LongType())]))


def segment_ends(batch: pa.RecordBatch) -> np.ndarray:
    """Segments of a batch (ax, ay, bx, by) as rows of numbers; those without a finite place reach nothing."""
    ends = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
    return ends[:, np.isfinite(ends).all(axis=0)]


def reached(segments: DataFrame, radius: float, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """The different segments (ax, ay, bx, by), stored; and the cells (_sx, _sy), a `parts`-th of the radius wide, of which some part may be within the radius of one,
    stored, with the least distance _d of their middle and whether all of the cell is within the radius."""
    size = radius / parts
    half = size / 2**0.5  # from the middle of a cell to its corner
    slack = 1e-9 * radius
    seg = stored(segments.select(*(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by"))).dropna().distinct(), "segments")

    def cells_of(batches):
        for batch in batches:
            for _, x, y, d in spots(segment_ends(batch), size, radius + half + slack):
                if not len(x):
                    continue
                order = np.lexsort((d, y, x))
                x, y, d = x[order], y[order], d[order]
                first = np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0))
                yield pa.RecordBatch.from_arrays([pa.array(v[first]) for v in (x, y, d)], ["_sx", "_sy", "_d"])

    near = map_arrow(spread(seg), cells_of, "_sx long, _sy long, _d double").groupBy("_sx", "_sy").agg(F.min("_d").alias("_d"))
    return seg, stored(near.withColumn("_all", F.col("_d") <= radius - half - slack), "cells")


def spread(seg: DataFrame) -> DataFrame:
    """Stored segments dealt to tasks by their number, as their size says nothing of the cells they become."""
    return seg.repartition(max(1, min(20_000, seg.count() // 2000)), "ax", "ay", "bx", "by")


def within_segments(points: DataFrame, segments: DataFrame, radius: float, name: str, keys: list[str], parts: int = 8) -> DataFrame:
    """Points (keys, x, y) with a boolean: whether any segment (ax, ay, bx, by) lies within the radius.

    Cells of an eighth of the radius are judged first. A cell whose middle is so near to a segment that all of it is within the radius has only such points, one farther
    than that from all segments has none; points are held against segments in the cells between alone, a band along the edge of what segments reach.
    """
    size = radius / parts
    at = lambda c: F.floor(F.col(c) / size)
    seg, near = reached(segments, radius, parts)
    near = near.drop("_d")
    rows = points.withColumns({"_sx": at("x"), "_sy": at("y")}).join(near, ["_sx", "_sy"], "left")
    edge = points.select(*keys, "x", "y").withColumns({"_sx": at("x"), "_sy": at("y")}).join(near.filter("not _all").select("_sx", "_sy"), ["_sx", "_sy"], "left_semi").drop("_sx", "_sy")
    edge = stored(edge, "edge")
    hit = stored(near_segments(edge, seg, radius, occupied=True).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_hit", F.lit(True)), "hit")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(hit, same, "left").withColumn(name, F.coalesce("_all", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_sx", "_sy", "_all", "_hit", *(f"_{k}" for k in keys))


def crossings(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Crossing segments: left (ax, ay, bx, by) with right (cx, cy, dx, dy), with the place and the shares u and v. A pair is made in the first cell that
    both touch, so pairs need not be told apart afterwards, and equal rows stay as many as they are."""
    # A place at an end, rounded, may lie a bit beyond it: cells are taken a bit wider.
    low = lambda a, b: F.least(a, b) - 1e-9 * size
    wide = lambda df, a, b, c: df.withColumn(c, F.explode(cells(low(a, b), F.greatest(a, b) + 1e-9 * size, size)))
    first = lambda cell, a, b, c, d: F.col(cell) == F.floor(F.greatest(low(a, b), low(c, d)) / size)
    a = wide(wide(left, "ax", "bx", "_x"), "ay", "by", "_y")
    b = wide(wide(right, "cx", "dx", "_x"), "cy", "dy", "_y")
    yes, u, v = segment_crossing(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")))
    both = met(a, b, ["_x", "_y"]).filter(first("_x", "ax", "bx", "cx", "dx") & first("_y", "ay", "by", "cy", "dy") & yes).drop("_x", "_y").withColumns({"u": u, "v": v})
    return both.withColumns({"px": F.col("ax") + F.col("u") * (F.col("bx") - F.col("ax")), "py": F.col("ay") + F.col("u") * (F.col("by") - F.col("ay"))})


def segments_of(vertices: DataFrame, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """Consecutive vertices of a line as segments ax, ay, bx, by, with the arc length before each."""
    w = Window.partitionBy(line).orderBy(seq)
    rows = vertices.withColumns({"ax": F.col("x"), "ay": F.col("y"), "bx": F.lead("x").over(w), "by": F.lead("y").over(w)})
    rows = rows.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    rows = rows.withColumn("s0", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.filter("bx is not null").drop("x", "y")


def interpolate(queries: DataFrame, known: DataFrame, at: str, station: str, value: str, on: list[str], outside: str = "null") -> DataFrame:
    """Value of a polyline (on, station, value) at each query station, straight between its vertices. outside: null, clamp or
    extrapolate. Queries and vertices are merged and sorted once per key, so there is no range join."""
    if outside not in ("null", "clamp", "extrapolate"):
        raise ValueError("outside is null, clamp or extrapolate")
    k = known.groupBy(*on, station).agg(F.avg(value).alias("_v")).select(*on, F.col(station).alias("_s"), "_v", F.lit(0).alias("_q"))
    q = queries.select(*on, F.col(at).cast("double").alias("_s"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_row"))
    every = k.withColumn("_row", F.lit(None).cast(q.schema["_row"].dataType)).unionByName(q)
    point = F.when(F.col("_q") == 0, F.struct(F.col("_s").alias("s"), F.col("_v").alias("v")))
    back = Window.partitionBy(*on).orderBy("_s", "_q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*on).orderBy(F.desc("_s"), "_q").rowsBetween(Window.unboundedPreceding, 0)  # backwards: a frame that shrinks costs a pass a row
    every = every.withColumn("_p", point).withColumns({"_a": F.last("_p", ignorenulls=True).over(back), "_b": F.last("_p", ignorenulls=True).over(ahead)})
    if outside == "extrapolate":
        # The outermost two knots of each key, so no key's knots are gathered.
        for name, by in (("_f", F.asc("_s")), ("_l", F.desc("_s"))):
            two = k.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(by))).filter("_r <= 2")
            two = two.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_v").alias("v")))).alias(name))
            every = every.join(two, on, "left")
    a, b = F.col("_a"), F.col("_b")
    mid = F.when(b["s"] == a["s"], a["v"]).otherwise(a["v"] + (F.col("_s") - a["s"]) / (b["s"] - a["s"]) * (b["v"] - a["v"]))
    if outside == "clamp":
        mid = F.coalesce(mid, a["v"], b["v"])
    elif outside == "extrapolate":
        line = lambda e: e[0]["v"] + (F.col("_s") - e[0]["s"]) / (e[1]["s"] - e[0]["s"]) * (e[1]["v"] - e[0]["v"])
        mid = F.coalesce(mid, F.when(a.isNull() & (F.size("_f") > 1), line(F.col("_f"))), F.when(b.isNull() & (F.size("_l") > 1), line(F.col("_l"))))
    return every.withColumn("_value", mid).filter("_q = 1").select("_row.*", F.col("_value").alias(value))


def nearest_band(features: DataFrame, bands: list[tuple[str, float, float]], offset: str) -> DataFrame:
    """Features with the band (name, centre, half width) whose centre is nearest and within its half width; null where there
    is none. Bands are parameters, so the choice is a column expression."""
    best = F.array_min(F.array(*(F.when(F.abs(F.col(offset) - c) <= h, F.struct(F.abs(F.col(offset) - c).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("band_id"))) for k, (name, c, h) in enumerate(bands))))
    return features.withColumn("band_id", best["band_id"])


def keyed_lookup(rows: DataFrame, records: DataFrame, keys: list[str], record_keys: list[str]) -> DataFrame:
    """Rows with the record that the first of their keys finds; of records with one key, the first by id. Columns: row_id, record_id (null: none)."""
    a = rows.select("row_id", F.posexplode(F.array(*(F.col(k) for k in keys))).alias("rank", "key")).filter("key is not null")
    b = records.select("record_id", F.explode(F.array(*(F.col(k) for k in record_keys))).alias("key")).filter("key is not null").groupBy("key").agg(F.min("record_id").alias("record_id"))
    best = a.join(b, "key").groupBy("row_id").agg(F.min(F.struct("rank", "record_id")).alias("m"))
    return rows.select("row_id").join(best, "row_id", "left").select("row_id", F.col("m.record_id").alias("record_id"))


def unmatched(matched: DataFrame, allowed: bool = False) -> DataFrame:
    """Rows without a record; an error if there are any and none is allowed."""
    out = matched.filter("record_id is null")
    if not allowed and out.limit(1).count():
        raise ValueError("rows without a matching record")
    return out
