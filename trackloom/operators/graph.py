"""Components, nodes and topology over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from ..storage import discard, stored
from .ranges import near_points


#: Counted edges up to which one task joins them (some 10 MB); more go round by round. It steers costs, not results.
FEW = 200_000


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v), by union-find in one task."""
    kind = edges.schema["u"].dataType

    def run(batches):
        parts = [np.column_stack([np.asarray(b.column(c)).astype(np.int64) for c in ("u", "v")]) for b in batches if b.num_rows]
        if not parts:
            return
        nodes, flat = np.unique(np.concatenate(parts), return_inverse=True)
        top = list(range(len(nodes)))
        for a, b in flat.reshape(-1, 2).tolist():
            while top[a] != a:
                top[a] = a = top[top[a]]
            while top[b] != b:
                top[b] = b = top[top[b]]
            if a != b:
                top[max(a, b)] = min(a, b)
        for k, x in enumerate(top):  # a top is no greater than its node, so it is settled already
            top[k] = top[x]
        as_kind = pa.int64() if isinstance(kind, T.LongType) else pa.int32()
        yield pa.RecordBatch.from_arrays([pa.array(nodes).cast(as_kind), pa.array(nodes[top]).cast(as_kind)], names=["node", "component"])

    return map_arrow(edges.select("u", "v").coalesce(1), run, f"node {kind.simpleString()}, component {kind.simpleString()}")


#: Rows of one node from which it is looked up by a broadcast: so many rows of one key would be sorted by one task. It steers costs, not results.
HOT = 50_000


def _with(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows joined with a table of one row for each key, whose `_n` says about how many rows have that key. Keys of many rows are few, as their rows add up to the
    table's size; they are broadcast, so that no task gets all rows of one key."""
    few = table.withColumnRenamed("u", key)
    hot = F.broadcast(few.filter(F.col("_n") > HOT).drop("_n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(few.filter(F.col("_n") <= HOT).drop("_n").hint("merge"), key)
    return cold.unionByName(rows.join(hot, key))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `edges` (a, b): the smallest node reachable.

    Large-star and small-star alternate until nothing moves: each node links to its smallest neighbour, so a path of any
    length closes in a logarithmic number of rounds; few edges are counted and joined at once instead. Only counts reach the driver; each round is written, which cuts the lineage.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    if before[0] <= FEW and isinstance(edges.schema["u"].dataType, (T.LongType, T.IntegerType)):
        return _joined(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("n"), F.count("*").alias("_n")).select("u", F.least("u", "n").alias("m"), "_n"), "low")
        # Neighbours above a node are the edges that have it as their lower end.
        large = _with(edges.select(F.col("v").alias("low"), F.col("u").alias("high")), "low", low).select(F.col("high").alias("u"), F.col("m").alias("v"))
        large = stored(large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "least")
        small = _with(large, "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        done, edges = edges, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(edges)
        discard(done, low, large, least)
        both = low = large = least = small = None
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    star = edges.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("node"), "component").unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def labelled(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """nodes with their component; a node without edges is its own."""
    found = components(edges)
    return nodes.join(found.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", F.col(key)))


def endpoint_clusters(ends: DataFrame, tolerance: float) -> DataFrame:
    """Endpoints (end_id, x, y, accepted) with their node and its anchor: the one accepted endpoint of the node, else the mean.

    All endpoints of a cell whose diagonal is no longer than the tolerance are one node, so edges are between cells, not between all that are near.
    """
    size = tolerance * (1 - 1e-9) / 2**0.5
    sound = ~F.isnan("x") & ~F.isnan("y")
    rows = ends.withColumns({f"_{c}": F.when(sound, F.floor(F.col(c) / size)) for c in ("x", "y")})
    heads = rows.groupBy("_x", "_y").agg(F.min("end_id").alias("_head")).filter("_x is not null and _y is not null")
    rows = rows.join(heads, ["_x", "_y"], "left").withColumn("_head", F.coalesce("_head", "end_id")).drop("_x", "_y")
    rows = stored(rows, "heads")
    other = rows.select(F.col("_head").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    own = rows.select(F.col("_head").alias("a"), "x", "y").distinct()
    edges = near_points(own, other, tolerance).filter("a < b").select("a", "b").distinct()
    found = components(edges)
    rows = rows.join(found.withColumnRenamed("node", "_head"), "_head", "left").withColumn("node", F.coalesce("component", "_head")).drop("component", "_head")
    accepted = F.col("accepted")
    at = lambda c: F.when(F.sum(accepted.cast("int")) == 1, F.max(F.when(accepted, F.col(c)))).otherwise(F.avg(c)).alias(f"anchor_{c}")
    return rows.join(rows.groupBy("node").agg(at("x"), at("y")), "node", "left").select(*ends.columns, "node", "anchor_x", "anchor_y")


def degrees(ends: DataFrame) -> DataFrame:
    """node, degree, dead_end of clustered endpoints."""
    return ends.groupBy("node").agg(F.count("*").alias("degree")).withColumn("dead_end", F.col("degree") == 1)


def grid_components(cells: DataFrame, least: int = 1) -> DataFrame:
    """Occupied cells (cx, cy, n >= least) with the component of their eight neighbours; a cell's number joins both indices."""
    kept = cells.filter(F.col("n") >= least).withColumn("cell", F.shiftleft(F.col("cx") + (1 << 30), 32) + F.col("cy") + (1 << 30))
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) > (0, 0)]
    step = kept.select("cell", F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in around))).alias("q")).select(F.col("cell").alias("a"), "q.*")
    edges = step.join(kept.select("cx", "cy", F.col("cell").alias("b")), ["cx", "cy"]).select("a", "b")
    return labelled(kept, edges, "cell")


def consensus(ends: DataFrame) -> DataFrame:
    """node, z: the median of endpoints that are no bridges, else of all."""
    return ends.groupBy("node").agg(F.coalesce(F.percentile(F.when(~F.col("bridge"), F.col("z")), 0.5), F.percentile("z", 0.5)).alias("z"))


def split_at_junctions(vertices: DataFrame, junctions: DataFrame) -> DataFrame:
    """Lines cut at stations (line_id, station): segment numbers on the vertices, with each cut as the end of one segment and the start of the next."""
    from .lines import arc_length, at_stations

    own = arc_length(vertices).select("line_id", "s", "x", "y")
    total = own.groupBy("line_id").agg(F.max("s").alias("_l"))
    cuts = junctions.join(total, "line_id").filter((F.col("station") > 1e-6) & (F.col("station") < F.col("_l") - 1e-6)).select("line_id", "station").distinct()
    cuts = at_stations(vertices, cuts).select("line_id", F.col("station").alias("s"), "x", "y", F.lit(1).alias("cut"))
    before = Window.partitionBy("line_id").orderBy("s", "cut").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("cut", F.lit(0)).unionByName(cuts).withColumn("segment", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    starts = rows.filter("cut = 1").withColumn("segment", F.col("segment") + 1)
    return rows.unionByName(starts).select("line_id", "segment", "s", "x", "y").distinct()
