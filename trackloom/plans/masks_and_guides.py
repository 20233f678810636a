"""Queries of masks, guides, gauge-constrained lines, UTM zones and the table function, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, tables
from ..operators import evidence, guides, masks, polygons
from . import points_and_lines  # noqa: F401  its SQL is used here
from .registry import ORACLE_SQL, query, table, vertices


def _months(spark, d):
    """Each supplier's image: a pixel for every month and quantity in which it sold."""
    month = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), month.alias("row"), F.col("l_quantity").cast("long").alias("col"))


_PIXELS = "p AS (SELECT DISTINCT l_suppkey AS image, floor(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 30)::BIGINT AS \"row\", l_quantity::BIGINT AS col FROM lineitem)"


@query("mask_components", f"""WITH RECURSIVE {_PIXELS}, c AS (SELECT *, (image << 40) + ("row" << 20) + col AS id FROM p),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.image = b.image AND ((a."row" = b."row" AND abs(a.col - b.col) = 1) OR (a.col = b.col AND abs(a."row" - b."row") = 1))),
w(id, seen) AS (SELECT id, id FROM c UNION SELECT w.id, e.b FROM w JOIN e ON w.seen = e.a),
m AS (SELECT id, min(seen) AS component FROM w GROUP BY id)
SELECT image, "row", col, component FROM c JOIN m USING (id)""")
def mask_components(spark, d):
    return masks.mask_components(_months(spark, d), diagonal=False, tile=16)


@query("mask_opened", f"""WITH {_PIXELS}, k AS (SELECT unnest(range(-1, 2)) AS k), s AS (SELECT image, "row" + i.k AS "row", col + j.k AS col FROM p, k i, k j),
e AS (SELECT image, "row", col FROM s GROUP BY ALL HAVING count(*) >= 4), g AS (SELECT image, "row" + i.k AS "row", col + j.k AS col FROM e, k i, k j)
SELECT image, "row", col FROM (SELECT image, "row", col FROM g GROUP BY ALL HAVING count(*) = 9) ORDER BY ALL""")
def mask_opened(spark, d):
    """Pixels with four set ones or more around them, and of these the ones whose square is set as a whole."""
    return masks.eroded(masks.crowded(_months(spark, d), 1, 4), 1)


@query("utm_round_trip", "SELECT c_custkey, 114 + (c_custkey % 600) / 100 AS lon, -80 + abs(c_acctbal) / 62.5 AS lat FROM customer")
def utm_round_trip(spark, d):
    """Customers at made up places, to zone 50 and back, by way of zone 51."""
    at = table(spark, d, "customer").select("c_custkey", (114 + F.col("c_custkey") % 600 / 100).alias("x"), (-80 + F.abs("c_acctbal") / 62.5).alias("y"))
    for a, b in ((4326, 32650), (32650, 32751), (32751, 4326)):
        at = geometry.reprojected(at, a, b)
    return at.select("c_custkey", F.round("x", 8).alias("lon"), F.round("y", 8).alias("lat"))


@query("densify_line", ORACLE_SQL["densify"])
def densify_line(spark, d):
    """`densify` as SQL says it, by the table function for many lines."""
    v = vertices(spark, d)
    tables.register(spark, v.schema["line_id"].dataType.simpleString())
    return spark.sql("SELECT line_id, k, station, x, y FROM densify_lines(TABLE({v}) PARTITION BY pmod(hash(line_id), 1024) ORDER BY (line_id, seq), 20.0D)", v=v)


@query("offset_peaks", """WITH t AS (SELECT l_quantity::DOUBLE AS t FROM lineitem), b AS (SELECT floor((t - (SELECT min(t) FROM t)) / 0.5)::BIGINT AS bin, count(*) AS n FROM t GROUP BY 1), m AS (SELECT max(bin) AS last FROM b),
g AS (SELECT unnest(range((SELECT last + 1 FROM m))) AS bin), s AS (SELECT g.bin, (SELECT coalesce(sum(n), 0) FROM b WHERE abs(b.bin - g.bin) <= 2) AS n FROM g),
x AS (SELECT *, lag(n) OVER (ORDER BY bin) AS before, lead(n) OVER (ORDER BY bin) AS after FROM s)
SELECT (SELECT min(t) FROM t) + (bin + 0.5) * 0.5 AS peak, n::BIGINT AS n FROM x, m WHERE bin BETWEEN 2 AND last - 2 AND n >= before AND n >= after AND n >= 10""")
def offset_peaks(spark, d):
    """All peaks of the quantities' histogram, none put aside for a neighbour."""
    return guides.offset_peaks(table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("t")), 0.5, 10, 0.0).select("peak", F.col("n").cast("long").alias("n"))


@query("constrained_lines")
def constrained_lines(spark, d):
    """Each order's line items along the ship days are a candidate, those of two pieces or more its gauge line."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), day.alias("s"), (F.col("l_quantity") / 20).alias("t"), "l_linenumber")
    return evidence.constrained(rows.select("key", "s", "t"), rows.filter("l_linenumber % 2 = 0").select("key", "s", "t"), ["key"])


@query("merged_zones")
def merged_zones(spark, d):
    """A four-cornered zone at each customer, and the outlines of what they cover together."""
    c = table(spark, d, "customer")
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((-1.0, -0.5), (1.0, -1.0), (0.7, 1.0), (-0.6, 0.8)))))).alias("k")
    half = 1 + F.col("c_nationkey") / 10
    rows = c.select(F.col("c_custkey").alias("polygon_id"), (F.col("c_acctbal") / 200).alias("cx"), (F.col("c_custkey") / 5).alias("cy"), half.alias("h"), corner)
    return polygons.union(rows.select("polygon_id", "k.seq", (F.col("cx") + F.col("h") * F.col("k.a")).alias("x"), (F.col("cy") + F.col("h") * F.col("k.b")).alias("y")), 4.0)
