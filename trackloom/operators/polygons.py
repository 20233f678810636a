"""Unions of polygons (polygon_id, seq, x, y): their outlines as rings, holes included.

Edges are cut where they meet others, found through cells, and a piece is kept if what lies to its right is in no polygon; rings run with the inside on
their left. Cutting and judging are joins over pieces. Kept pieces are put in order tile by tile: what runs through a tile becomes one run, runs are put in order
in wider tiles, and so on, so that no task holds more than a tile of pieces or runs, however long a ring is. Zones, polygons whose boxes overlap, directly or through
others, are joined within tiles first, then over what lies in several.

Coordinates are rounded to `grid`, so places that are one but for rounding are one. A polygon of fewer than three places, or without area, counts for nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_runs
from ..storage import stored
from .graph import _with, components
from .ranges import cells, dealt, met
from .sampling import positions

#: Cells along a side of a tile; how many tiles make one of the next level; runs that one task puts in order. They steer costs, not results.
TILE, WIDER, RUNS = 64, 8, 50_000
#: What is known of a run: the runs before it and its last piece, whether it closes, its number of pieces, its least piece and where that stands in it, where it starts, its area in parts.
RUN = "came long, tail long, closed boolean, n long, lax double, lay double, lbx double, lby double, polygon_id long, least_at long, hx double, hy double, doubled array<double>"


def _edges(polygons: DataFrame, grid: float) -> DataFrame:
    """polygon_id and the directed edges ax, ay, bx, by, each polygon to the left of its own."""
    at = lambda c: (F.round(F.col(c) / grid) * grid).alias(c)
    rows = polygons.select("polygon_id", "seq", at("x"), at("y")).dropna()
    w = Window.partitionBy("polygon_id").orderBy("seq")
    after = F.coalesce(F.lead(F.struct("x", "y")).over(w), F.first(F.struct("x", "y")).over(w))  # the last place goes on to the first
    rows = rows.select("polygon_id", F.col("x").alias("ax"), F.col("y").alias("ay"), after.alias("_b")).select("polygon_id", "ax", "ay", F.col("_b.x").alias("bx"), F.col("_b.y").alias("by"))
    rows = rows.filter("ax <> bx or ay <> by")
    area = rows.groupBy("polygon_id").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("_area"), F.count("*").alias("_n"))
    rows = rows.join(area.filter((F.col("_n") > 2) & (F.abs("_area") > grid * grid)), "polygon_id")
    turn = F.col("_area") < 0
    return rows.select("polygon_id", *(F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))))


def _pieces(edges: DataFrame, size: float, grid: float) -> DataFrame:
    """Edges cut at all places where they cross or touch others."""
    rows = edges.withColumn("edge", F.xxhash64("ax", "ay", "bx", "by")).dropDuplicates(["ax", "ay", "bx", "by"])  # of equal edges one is enough
    spread = lambda df, a, b, c, d: df.withColumn("_x", F.explode(cells(F.least(a, c), F.greatest(a, c), size))).withColumn("_y", F.explode(cells(F.least(b, d), F.greatest(b, d), size)))
    one = spread(rows.select("edge", "ax", "ay", "bx", "by"), "ax", "ay", "bx", "by")
    other = spread(rows.select(F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy")), "cx", "cy", "dx", "dy")
    near = lambda a, b, c, d: (F.least(a, b) <= F.greatest(c, d) + 2 * grid) & (F.least(c, d) <= F.greatest(a, b) + 2 * grid)
    first = lambda k, a, b, c, d: F.col(k) == F.floor(F.greatest(F.least(a, b), F.least(c, d)) / size)
    pairs = met(one, other, ["_x", "_y"]).filter(near("ax", "bx", "cx", "dx") & near("ay", "by", "cy", "dy"))
    pairs = pairs.filter(first("_x", "ax", "bx", "cx", "dx") & first("_y", "ay", "by", "cy", "dy")).drop("_x", "_y").filter("not (ax = cx and ay = cy and bx = dx and by = dy)")
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    cross, wx, wy = ux * vy - uy * vx, F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    length = F.hypot(ux, uy)
    u, v = (wx * vy - wy * vx) / cross, (wx * uy - wy * ux) / cross
    proper = F.when((F.abs(cross) > 1e-12) & u.between(0, 1) & v.between(0, 1), u)
    on = lambda x, y: F.when(F.abs((F.col(x) - F.col("ax")) * uy - (F.col(y) - F.col("ay")) * ux) / length <= grid, ((F.col(x) - F.col("ax")) * ux + (F.col(y) - F.col("ay")) * uy) / (length * length))
    cuts = pairs.select("edge", F.explode(F.array(proper, on("cx", "cy"), on("dx", "dy"))).alias("u")).filter("u > 0 and u < 1")
    cuts = cuts.groupBy("edge").agg(F.array_sort(F.collect_set("u")).alias("us"))
    rows = rows.join(cuts, "edge", "left").withColumn("us", F.concat(F.array(F.lit(0.0)), F.coalesce("us", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    rows = rows.withColumns({"_u": F.slice("us", 1, F.size("us") - 1), "_v": F.slice("us", 2, F.size("us") - 1)}).withColumn("p", F.explode(F.arrays_zip("_u", "_v")))
    at = lambda u, a, b: F.round((F.col(a) + F.col(f"p.{u}") * (F.col(b) - F.col(a))) / grid) * grid
    parts = rows.select("polygon_id", *(at(u, a, b).alias(c) for c, u, a, b in (("ax", "_u", "ax", "bx"), ("ay", "_u", "ay", "by"), ("bx", "_v", "ax", "bx"), ("by", "_v", "ay", "by")))).filter("ax <> bx or ay <> by")
    return parts.groupBy("ax", "ay", "bx", "by").agg(F.min("polygon_id").alias("polygon_id"))


def covered(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """The points (point_id, x, y) that lie in a polygon, by its edges; a ray to the right crosses them an odd number of times."""
    box = edges.groupBy("polygon_id").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"))
    box = box.withColumn("_x", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("_y", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    rows = points.withColumns({"_x": F.floor(F.col("x") / size), "_y": F.floor(F.col("y") / size)}).join(dealt(box), ["_x", "_y"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    rows = rows.select("point_id", "x", "y", "polygon_id", "_y")
    rising = edges.select("polygon_id", "ax", "ay", "bx", "by", F.explode(cells(F.least("ay", "by"), F.greatest("ay", "by"), size)).alias("_y"))
    pairs = rows.join(dealt(rising), ["polygon_id", "_y"])
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right = F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    odd = pairs.groupBy("point_id", "polygon_id").agg((F.count_if(spans & right) % 2).alias("odd")).filter("odd = 1")
    return odd.select("point_id").distinct()


def _after(ax, ay, bx, by, own) -> list[int]:
    """The piece that follows each one, or -1: at a place where several go on, the first one clockwise from where the ring came keeps it from crossing itself."""
    out: dict[tuple, list[int]] = {}
    for k, p in enumerate(zip(ax, ay, strict=True)):
        if own[k]:
            out.setdefault(p, []).append(k)
    after, taken = [-1] * len(ax), [False] * len(ax)
    for k, p in enumerate(zip(bx, by, strict=True)):
        ways = [j for j in out.get(p, ()) if not taken[j]]
        if len(ways) > 1:
            back = math.atan2(ay[k] - by[k], ax[k] - bx[k])
            ways = [min(ways, key=lambda j: (back - math.atan2(by[j] - ay[j], bx[j] - ax[j])) % (2 * math.pi) or 2 * math.pi)]
        if ways:
            after[k], taken[ways[0]] = ways[0], True
    return after


def _chains(after: list[int], own) -> list[tuple[int, bool, list[int]]]:
    """What came before (or -1), whether it closes, and the members of each chain of own rows. A closed one starts at its first row."""
    before = [-1] * len(after)
    for k, j in enumerate(after):
        if j >= 0:
            before[j] = k
    chains, used = [], [not o for o in own]
    starts = [k for k in range(len(after)) if own[k] and (before[k] < 0 or not own[before[k]])]
    for start in (*starts, *range(len(after))):
        chain, k = [], start
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = after[k]
        if chain:
            chains.append((before[start] if not own[before[start]] else -1, k == start, chain))
    return chains


def _parts(values) -> list[float]:
    """A few numbers with the exact sum of many, so that a sum of sums is rounded once."""
    values, out = list(values), []
    while s := math.fsum(values):
        out.append(s)
        values.append(-s)
    return out


_PLACED = [("run", pa.int64()), ("into", pa.int64()), ("at", pa.int64())]
_RUN = [
    ("came", pa.int64()), ("tail", pa.int64()), ("closed", pa.bool_()), ("n", pa.int64()), ("lax", pa.float64()), ("lay", pa.float64()), ("lbx", pa.float64()), ("lby", pa.float64()),
    ("polygon_id", pa.int64()), ("least_at", pa.int64()), ("hx", pa.float64()), ("hy", pa.float64()), ("doubled", pa.list_(pa.float64())),
]


def _batch(rows: list[tuple], kinds) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _in_tiles(pieces: DataFrame, side: float) -> DataFrame:
    """run (the piece), into (the run it is in, named by that one's first piece), at, ax, ay; and on first pieces what is known of the run. A tile also sees the
    pieces that lead into it, so it has all that meet at its places."""
    tile = lambda x, y: F.struct(F.floor(F.col(x) / side).alias("tx"), F.floor(F.col(y) / side).alias("ty"))
    rows = pieces.withColumn("t", F.explode(F.array_distinct(F.array(tile("ax", "ay"), tile("bx", "by"))))).withColumn("own", F.col("t") == tile("ax", "ay"))
    rows = rows.select("point_id", "polygon_id", "ax", "ay", "bx", "by", "own", "t.tx", "t.ty")

    def run(batch, starts):
        found, names = [], ("point_id", "polygon_id", "ax", "ay", "bx", "by", "own")
        c = {n: np.asarray(batch.column(n)) if n != "own" else batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        for a, b in zip(starts, starts[1:], strict=False):
            name, polygon, ax, ay, bx, by, own = (c[n][a:b].tolist() for n in names)
            for came, closed, ks in _chains(_after(ax, ay, bx, by, own), own):
                k, least, first = ks[0], min(ks), name[ks[0]]  # rows are in the order of ax, ay, bx, by
                known = (
                    name[came] if came >= 0 else None, name[ks[-1]], closed, len(ks), ax[least], ay[least], bx[least], by[least], polygon[least], ks.index(least), ax[k], ay[k],
                    _parts(ax[k] * by[k] - bx[k] * ay[k] for k in ks),
                )
                found.append((first, first, 0, ax[k], ay[k], *known))
                found += [(name[k], first, at, ax[k], ay[k], *[None] * len(known)) for at, k in enumerate(ks[1:], 1)]
        return _batch(found, [*_PLACED, ("ax", pa.float64()), ("ay", pa.float64()), *_RUN])

    return map_runs(rows, ["tx", "ty"], ["ax", "ay", "bx", "by"], run, f"run long, into long, at long, ax double, ay double, {RUN}")


def _in_wider(runs: DataFrame, side: float | None) -> DataFrame:
    """The same of runs in wider tiles, or in one (None): run, into, at, and what is known."""
    of = lambda c: F.floor(F.col(c) / side) if side else F.lit(0).cast("long")

    def run(batch, starts):
        found = []
        c = {n: batch.column(n).to_pylist() for n in ("run", *(n for n, _ in _RUN))}
        for a, b in zip(starts, starts[1:], strict=False):
            v = {n: x[a:b] for n, x in c.items()}
            follows = {came: k for k, came in enumerate(v["came"]) if came is not None}
            for _, closed, ks in _chains([follows.get(tail, -1) for tail in v["tail"]], [True] * (b - a)):
                ends = np.cumsum([v["n"][k] for k in ks]).tolist()
                order, j = min(((v["lax"][k], v["lay"][k], v["lbx"][k], v["lby"][k]), j) for j, k in enumerate(ks))
                k, least, first = ks[0], ks[j], v["run"][ks[0]]
                begins = [0, *ends[:-1]]
                known = (
                    None if closed else v["came"][k], v["tail"][ks[-1]], closed, ends[-1], *order, v["polygon_id"][least], begins[j] + v["least_at"][least], v["hx"][k], v["hy"][k],
                    _parts(x for k in ks for x in v["doubled"][k]),
                )
                found.append((first, first, 0, *known))
                found += [(v["run"][k], first, at, *[None] * len(known)) for k, at in zip(ks[1:], begins[1:], strict=True)]
        return _batch(found, [*_PLACED, *_RUN])

    rows = runs.withColumns({"tx": of("hx"), "ty": of("hy")})
    return map_runs(rows, ["tx", "ty"], ["run"], run, f"run long, into long, at long, {RUN}")


def _zones(edges: DataFrame, size: float) -> DataFrame:
    """polygon_id, zone: the least polygon that shares a cell, directly or through others. Boxes of one cell that do not overlap only share a zone's name."""
    box = edges.groupBy("polygon_id").agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    wide = box.withColumn("_x", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("_y", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    wide = wide.select(F.col("polygon_id").cast("long").alias("polygon_id"), "_x", "_y", F.floor(F.col("_x") / TILE).alias("tx"), F.floor(F.col("_y") / TILE).alias("ty"))

    def run(batch, starts):
        found = []
        ids, xs, ys = (np.asarray(batch.column(n)) for n in ("polygon_id", "_x", "_y"))
        for a, b in zip(starts, starts[1:], strict=False):
            nodes, flat = np.unique(ids[a:b], return_inverse=True)
            same = ((xs[a + 1 : b] == xs[a : b - 1]) & (ys[a + 1 : b] == ys[a : b - 1])).tolist()
            flat, top = flat.tolist(), list(range(len(nodes)))
            for p, q, one in zip(flat, flat[1:], same, strict=False):
                if one:
                    while top[p] != p:
                        top[p] = p = top[top[p]]
                    while top[q] != q:
                        top[q] = q = top[top[q]]
                    if p != q:
                        top[max(p, q)] = min(p, q)
            for k, x in enumerate(top):
                top[k] = top[x]
            found.append(pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[top], pa.int64())], names=["polygon_id", "root"]))
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    local = stored(map_runs(wide, ["tx", "ty"], ["_x", "_y", "polygon_id"], run, "polygon_id long, root long"), "local")
    least = F.min("root").over(Window.partitionBy("polygon_id"))
    joined = components(local.withColumn("b", least).filter("root <> b").select(F.col("root").alias("a"), "b").distinct())
    own = local.groupBy("polygon_id").agg(F.min("root").alias("node"))
    return own.join(joined, "node", "left").select("polygon_id", F.coalesce("component", "node").alias("zone"))


def _ordered(pieces: DataFrame, zones: DataFrame, side: float) -> DataFrame:
    """zone, ring, area, seq, x, y of pieces that are put in order. What does not close ends where nothing goes on."""
    levels = [stored(_in_tiles(pieces, side), "runs")]
    runs = lambda level: level.filter("at = 0").select(F.col("into").alias("run"), *(n for n, _ in _RUN))
    while side is not None:
        going = runs(levels[-1]).filter("not closed")
        many = going.count()
        side = side * WIDER if many > RUNS else None
        levels.append(stored(_in_wider(going, side), "runs"))
    # Rings are numbered in a zone by their least pieces.
    rings = [runs(level).filter("closed" if level is not levels[-1] else "true").withColumn("level", F.lit(k)) for k, level in enumerate(levels)]
    rings = [r.select("run", "level", "closed", "n", "least_at", "polygon_id", "doubled", F.struct("lax", "lay", "lbx", "lby").alias("least")) for r in rings]
    every = rings[0]
    for r in rings[1:]:
        every = every.unionByName(r)
    every = stored(every.join(zones, "polygon_id", "left").withColumn("order", F.struct("zone", "least")), "rings")
    every = stored(positions(every, "order", "pos"), "rings")
    zone = every.groupBy("zone").agg(F.min("pos").alias("first"), F.count("*").alias("_n")).withColumnRenamed("zone", "u")
    every = _with(every, "zone", zone).select("run", "level", "closed", "n", "least_at", "doubled", "zone", (F.col("pos") - F.col("first")).cast("int").alias("ring"))
    every = stored(every, "rings")
    known = ["zone", "ring", "closed", "n", "least_at", "doubled"]
    placed = None
    for k, level in reversed(list(enumerate(levels))):
        # Where the runs of this level lie: in rings that end here, or further on in a run of the next.
        here = every.filter(F.col("level") == k).select(F.col("run").alias("into"), F.lit(0).cast("long").alias("start"), *known)
        here = here if placed is None else here.unionByName(placed.select(F.col("run").alias("into"), "start", *known))
        columns = ["run", (F.col("start") + F.col("at")).alias("start"), *known] if k else [*known, (F.col("start") + F.col("at")).alias("at"), "ax", "ay"]
        placed = level.select("into", "run", "at", *(() if k else ("ax", "ay"))).join(here.hint("merge"), "into").select(*columns)
        placed = stored(placed, "placed") if k else placed
    seq = F.when(F.col("closed"), F.pmod(F.col("at") - F.col("least_at"), F.col("n"))).otherwise(F.col("at")).cast("int").alias("seq")
    return placed.select("zone", "ring", "doubled", seq, F.col("ax").alias("x"), F.col("ay").alias("y"))


def union(polygons: DataFrame, size: float, grid: float = 1e-6) -> DataFrame:
    """zone, ring, hole, area, seq, x, y: the outlines of the union of polygons (polygon_id long, seq, x, y). A ring's area is negative where it is a hole. `size` is that of a
    cell, about that of an edge; zones are groups of polygons whose boxes overlap, named by their least polygon_id."""
    edges = stored(_edges(polygons, grid), "edges")
    pieces = stored(_pieces(edges, size, grid), "pieces").withColumn("point_id", F.xxhash64("ax", "ay", "bx", "by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    away = 10 * grid / F.hypot(dx, dy)
    right = pieces.select("point_id", ((F.col("ax") + F.col("bx")) / 2 + dy * away).alias("x"), ((F.col("ay") + F.col("by")) / 2 - dx * away).alias("y"))
    kept = pieces.join(covered(right, edges, size), "point_id", "left_anti").withColumn("polygon_id", F.col("polygon_id").cast("long"))
    rows = _ordered(kept, _zones(edges, size), size * TILE).withColumn("area", 0.5 * F.coalesce(F.get("doubled", F.lit(0)), F.lit(0.0)))  # the first part is the rounded sum
    return rows.select("zone", "ring", (F.col("area") < 0).alias("hole"), "area", "seq", "x", "y")
