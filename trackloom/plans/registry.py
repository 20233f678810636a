"""Queries over the driver's tables and the SQL for each. The tables hold no geometry, so views give theirs:
line items are vertices (order = line, line number = place, quantity and price = x and y), events are samples (event = station,
value = offset, user = track), embeddings, customers and suppliers are points, orders are intervals in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_quantity").alias("x"), (F.min("l_extendedprice") / 1000).alias("y"), (F.min("l_discount") * 100).alias("z"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("track"), F.col("event_id").cast("double").alias("station"), F.col("value").alias("offset"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *((e[k].cast("double") * 100).alias(c) for k, c in enumerate("xyz")))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("track"), day.alias("low"), (day + F.floor(F.col("o_totalprice") / 10000)).alias("high"))


def r(c, digits: int = 5):
    return F.round(c, digits)


# The same views in SQL.
V = "v AS (SELECT l_orderkey AS line_id, l_linenumber AS seq, min(l_quantity) AS x, min(l_extendedprice) / 1000 AS y, min(l_discount) * 100 AS z FROM lineitem GROUP BY 1, 2)"
S = 's AS (SELECT event_id AS id, user_id AS track, event_id::DOUBLE AS station, value AS "offset" FROM events)'
P = "p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)"
I = "i AS (SELECT o_orderkey AS id, o_custkey AS track, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS low, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE + floor(o_totalprice / 10000) AS high FROM orders)"  # noqa: E741
