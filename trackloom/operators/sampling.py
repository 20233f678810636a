"""Deterministic sampling, quotas and ranks. Row numbers over a whole table are summed from partition counts, so no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def positions(rows: DataFrame, order: str, name: str = "pos", buckets: int | None = None) -> DataFrame:
    """Rows with their position from 0 in the order of a column (unique). Rows are range-partitioned and written once, as the ranges are
    drawn from a sample and another plan would draw others; a partition's start is the sum of the counts before it."""
    ranged = rows.repartitionByRange(buckets, order) if buckets else rows.repartitionByRange(order)
    parts = stored(ranged.withColumn("_p", F.spark_partition_id()), "ranged")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    numbered = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return numbered.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + F.col("_k")).cast("long")).drop("_p", "_k", "_start")


def even(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows at evenly spaced positions, first and last included; all if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    if most <= 1:
        return rows.orderBy(order).limit(max(most, 0))
    p = F.col("_pos")
    # Position p is taken if it is floor(k (n - 1) / (most - 1)) for some k.
    k = F.floor((p * (most - 1) + (n - 2)) / (n - 1))
    return positions(rows, order, "_pos").filter(F.floor(k * (n - 1) / (most - 1)) == p).drop("_pos")


def stride(rows: DataFrame, keys: list[str], order: str, step: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w) - 1).filter(F.col("_k") % step == 0).drop("_k")


def quotas(groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """A total shared among groups in proportion to their sizes: whole parts first, then the largest remainders; 1 at least for a group that has rows."""
    everything = F.sum(size).over(Window.partitionBy())
    exact = F.col(size) * F.lit(float(total)) / everything
    rows = groups.filter(F.col(size) > 0).withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_x") - F.col("_f")), key))
    rows = rows.withColumns({"_r": rank, "_left": F.lit(total) - F.sum("_f").over(Window.partitionBy())})
    quota = F.greatest(F.lit(1), F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0))
    return rows.select(key, size, F.least(quota, F.col(size)).cast("long").alias("quota"))


def top(rows: DataFrame, keys: list[str], score: Column, ties: str, most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(score.desc(), ties)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def balanced(rows: DataFrame, label: str, key: str, total: int, share: float = 0.8, seed: int = 0) -> DataFrame:
    """At most a share of positives and the rest negatives, in the order of a seeded hash."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    most = F.when(F.col(label), int(total * share)).otherwise(total - int(total * share))
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def every_nth_split(rows: DataFrame, order: str, every: int) -> DataFrame:
    """`split`: every n-th row is val, the others train."""
    p = positions(rows, order, "_pos")
    return p.withColumn("split", F.when(F.col("_pos") % every == 0, "val").otherwise("train")).drop("_pos")


def stratified(rows: DataFrame, key: str, tier: str, score: str, bins: str, total: int, focus: int) -> DataFrame:
    """First the best `focus` rows of tier 0, then the best of each bin, then the best of the rest, `total` in all."""
    first = F.row_number().over(Window.partitionBy(tier).orderBy(F.desc(score), key))
    best = F.row_number().over(Window.partitionBy(bins).orderBy(F.desc(score), key))
    ranked = rows.withColumns({"_f": first, "_b": best})
    level = F.when((F.col(tier) == 0) & (F.col("_f") <= focus), 0).when(F.col("_b") == 1, 1).otherwise(2)
    return ranked.withColumn("_level", level).orderBy("_level", F.desc(score), key).limit(total).drop("_f", "_b", "_level")
