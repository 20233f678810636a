"""Exact deduplication: of rows whose texts are equal byte by byte, one stays. DataFrame functions only.

Rows are grouped by a 128-bit hash of the text; the row with the smallest (or largest) stable id stays. Equal hashes are not
taken for equal texts: the texts of every group of two or more are compared, by the least and the greatest text of the group,
which partial aggregation keeps at one pair a partition and group however many copies there are. Groups whose texts differ
are split by the texts themselves. Texts that stand alone are hashed once and compared with nothing.

Hot groups: counts, ids and least and greatest texts aggregate before they are shuffled. What the rows learn of their group
comes from a broadcast of the groups where these are counted and few; else from a broadcast of the groups that hold more than
one in SHARE rows (fewer than SHARE groups, whatever the table's size), and from a shuffle for all others, none of them hot.

Defined results: a null text counts as empty, so null and empty texts are one group. A null id is never the one that stays
beside an id that is not null; of rows with equal ids and texts exactly one stays. `keep_id` is the id of the row that stays,
null if no row of the group has one. An empty table gives an empty one. Extra columns pass through `deduplicated` unchanged,
whatever their names. Texts are hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: A group with more than one in so many rows is hot; there are fewer such groups than this number.
SHARE = 1000
#: Bytes that a group takes in a broadcast: hash, id, row and count with what Spark adds.
GROUP_BYTES = 128
#: Parts into which the rows of texts with equal hashes are dealt.
SALTS = 32


def half(sha256: Column) -> Column:
    """The first 128 bits of a SHA-256."""
    return F.substring(sha256, 1, 16)


def _keyed(docs: DataFrame, doc_id: str, text: str, normalise: Callable[[Column], Column], digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    whole = normalise(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("id"), whole.alias("text"), *more)
    return rows.withColumn("sha256", F.unhex(F.sha2("text", 256))).withColumn("hash", digest(F.col("sha256")))


def _stays(keep: str) -> Column:
    """(rank of null ids, id, row) of the row that stays; of equal ids the first row."""
    if keep == "smallest":
        return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    if keep == "largest":
        return F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", (-F.col("row")).alias("row")))
    raise ValueError("keep is 'smallest' or 'largest'")


def _met(rows: DataFrame, groups: DataFrame, how: str, total: int) -> DataFrame:
    """rows joined on `hash` with stored groups, each hash of which stands once and has its number of rows in `n`."""
    if groups.count() * GROUP_BYTES <= base.BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), "hash", how)
    hot = F.broadcast(groups.filter(F.col("n") * SHARE > total))
    own = rows.join(hot, "hash", "left_semi" if how == "left_semi" else "inner")
    return own.unionByName(rows.join(hot, "hash", "left_anti").join(groups.filter(F.col("n") * SHARE <= total), "hash", how))


def _verdict(rows: DataFrame, *more: str) -> DataFrame:
    """rows with `stays` and `n` of their group, both null where the row stands alone."""
    alone = F.col("n").isNull()
    return rows.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.abs("stays.row") == F.col("row"))).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"), *more,
    )


def decisions(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda c: c, digest: Callable[[Column], Column] = half, carry: bool = False,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row; with `carry` also its own columns, in the struct `own`.

    Texts are equal when they are identical after `normalise`; `digest` makes the 128-bit hash of a text's SHA-256.
    """
    own = (F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("own"),) if carry else ()
    more = ("own",) if carry else ()
    keys = _keyed(docs, doc_id, text, normalise, digest, *own).drop("text")
    keys = base.stored(keys.withColumn("row", F.monotonically_increasing_id()), "keys")  # written once, so the numbers stand
    groups = keys.groupBy("hash").agg(F.count("*").alias("n"), _stays(keep).alias("stays")).filter("n > 1")
    groups, total = base.stored(groups, "groups"), keys.count()
    texts = _met(_keyed(docs, doc_id, text, normalise, digest).select("hash", "text"), groups.select("hash", "n"), "left_semi", total)
    differ = texts.groupBy("hash").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("hash")
    differ = base.stored(differ, "differ")
    collisions = differ.count()
    if not collisions:
        return _verdict(_met(keys, groups, "left", total), *more)
    small = collisions * GROUP_BYTES <= base.BROADCAST_BYTES
    differ = F.broadcast(differ) if small else differ
    out = _verdict(_met(keys.join(differ, "hash", "left_anti"), groups, "left", total), *more)
    rows = base.stored(_keyed(docs, doc_id, text, normalise, digest, *own).join(differ, "hash", "left_semi").withColumn("row", F.monotonically_increasing_id()), "collided")
    classes = rows.groupBy("hash", "text").agg(F.count("*").alias("n"), _stays(keep).alias("stays"))
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    split = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(classes, ["hash", "text", "salt"])
    return out.unionByName(_verdict(split, *more))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    return decisions(docs, doc_id, text, keep, normalise, carry=True).filter("kept").select("own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(base.table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t"""
