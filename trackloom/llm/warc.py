"""WARC archives: written by Spark's text writer (so a lost task leaves nothing half done) and read back by a scan that
splits files at the record magic, wherever it stands. Every magic is a candidate record; each task emits its offset and the
offset of its successor as its own headers tell it. Pointer jumping from the start of each file then keeps the candidates
that the chain reaches, and a magic inside a payload, which nothing points to, falls back into the payload around it.

Pointers are jumped over runs: candidates of a file whose successors are the next candidates form a run, which has one way
out. A sound file is one run; each false magic adds two. So the jumps are few and their table is small.

Defined results: a null payload is empty; a null url is written as an empty target. Repeated ids are written again and read
again, and the copies of one row are told apart by where they stand. Of equal payloads the largest page_id is the response; rows that tie on it too are all responses.
An empty table gives no archive rows. Extra columns are not read. An archive whose chain of records breaks before its end is an error, unless its sound beginning is asked for.
Payloads are written and read whole; they must be text in UTF-8, as archives of compressed records are not split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

MAGIC = "WARC/1.1\r\n"
#: Payloads of fewer bytes are never told by reference.
LEAST = 1000
#: Most bytes of the table of references that goes to every executor; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
PER_FILE = 20_000
_REFERENCE_BYTES = 24


def references(pages: DataFrame) -> DataFrame:
    """page_id, refers_to: rows whose payload (of LEAST bytes or more) another row with a larger id holds.

    Counts are summed per digest before the shuffle; a digest that stands once drops out before anything is joined.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= LEAST).select("page_id", "digest")
    most = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least")
    return known.join(most, "digest").filter("page_id < refers_to").select("page_id", "refers_to").distinct()


def records(pages: DataFrame) -> DataFrame:
    """value: the bytes of each record but for the magic before it and the last line end after it, as text."""
    found = base.stored(references(pages), "references")
    small = found.count() * _REFERENCE_BYTES <= BROADCAST_BYTES
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).join(F.broadcast(found) if small else found, "page_id", "left")
    digest, size, again = F.sha1(F.col("html").cast("binary")), F.octet_length("html"), F.col("refers_to").isNotNull()
    head = [
        F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(again, F.lit(0)).otherwise(size).cast("string"), F.lit("\r\n\r\n"),
    ]
    return rows.select(F.concat(F.lit(MAGIC), *head, F.when(again, F.lit("")).otherwise(F.col("html")), F.lit("\r\n")).alias("value"))


def write(pages: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Write the archives: files of gzip, of per_file records at most."""
    records(pages).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _header(name: str) -> Column:
    got = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(got != "", got)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each magic: where it stands, where its record ends by its own word, its headers, and the digest of its
    payload where that lies before the next magic. Texts stay in the scan."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))
    cut = F.instr(F.col("value").cast("string"), "\r\n\r\n")  # headers are ASCII, so characters are bytes there
    rows = raw.withColumn("cut", cut).withColumn("head", F.expr("substring(value, 1, greatest(cut - 1, 0))").cast("string"))
    length = F.expr("try_cast(_length as bigint)")
    rows = rows.withColumn("_length", _header("Content-Length")).withColumn("length", F.when((F.col("cut") > 0) & (length >= 0), length)).drop("_length")
    whole = F.octet_length("value") >= F.col("cut") + 3 + F.col("length")
    payload = F.expr("substring(value, cut + 4, cast(least(length, 2147483000) as int))")
    return rows.select(
        "file", "block", "at", F.octet_length("value").cast("long").alias("size"),
        F.when(F.col("length").isNotNull(), F.lit(len(MAGIC)) + F.col("cut") + 3 + F.col("length") + 4).alias("span"), "cut", "length",
        F.when(whole, F.sha1(payload)).alias("digest"), _header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("id"), _header("WARC-Refers-To").alias("refers"), _header("WARC-Payload-Digest").alias("told"),
    )


def placed(found: DataFrame) -> DataFrame:
    """Candidates with their byte offset in the file (`offset`) and their successor's (`next`)."""
    parts = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("all"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("_in", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0))).join(parts, ["file", "block"])
    rows = rows.withColumn("offset", F.col("base") + F.col("_in") - len(MAGIC)).filter("offset >= 0")  # what stands before the first magic is no candidate
    return rows.withColumn("next", F.col("offset") + F.col("span")).drop("_in", "base", "span")


def reachable(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches."""
    order = Window.partitionBy("file").orderBy("offset")
    rows = rows.withColumn("_cut", F.coalesce((F.lag("next").over(order) != F.col("offset")).cast("int"), F.lit(1)))
    rows = base.stored(rows.withColumn("run", F.sum("_cut").over(order)).drop("_cut"), "candidates")
    runs = rows.groupBy("file", "run").agg(F.max_by("next", "offset").alias("out"))
    aims = runs.filter("out is not null").select("file", F.col("run").alias("source"), F.col("out").alias("offset"))
    jumps = aims.join(rows.select("file", "offset", F.col("run").alias("to")), ["file", "offset"]).select("file", "source", "to", "offset")
    jumps = base.stored(jumps, "jumps")
    reached = rows.filter("offset = 0").select("file", "run")
    hop = jumps.select("file", "source", "to")
    count = reached.count() if jumps.limit(1).count() else None
    for _ in range(rounds if count is not None else 0):
        more = reached.join(hop.withColumnRenamed("source", "run"), ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = base.stored(reached.unionByName(more).distinct(), "reached")
        after = reached.count()
        if after == count:
            break
        count = after
        hop = base.stored(hop.alias("a").join(hop.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.source"))).select("a.file", "a.source", "b.to"), "hops")
    entries = reached.join(jumps.withColumnRenamed("source", "run"), ["file", "run"]).select("file", F.col("to").alias("run"), "offset")
    entries = entries.unionByName(rows.filter("offset = 0").select("file", "run", "offset")).groupBy("file", "run").agg(F.min("offset").alias("_from"))
    return rows.join(entries, ["file", "run"]).filter("offset >= _from").drop("_from", "run")


def unreached(found: DataFrame, kept: DataFrame) -> DataFrame:
    """file, reached, bytes of the files whose chain of records does not end where the file ends: broken, cut off, or no archive."""
    whole = found.groupBy("file").agg((F.sum(F.col("size") + len(MAGIC)) - len(MAGIC)).alias("bytes"))
    ends = kept.groupBy("file").agg(F.max("next").alias("reached"))
    return whole.join(ends, "file", "left").select("file", F.coalesce("reached", F.lit(0)).alias("reached"), "bytes").filter("reached <> bytes and bytes > 0")


def read(spark: SparkSession, path: str, broken: str = "raise") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; what a revisit has comes from the record it names.

    The digest of a payload that holds the magic is taken from its pieces, in order; only their scan is repeated. Files whose
    chain does not reach their end are an error, or with broken="keep" give the records up to there.
    """
    if broken not in ("raise", "keep"):
        raise ValueError("broken is 'raise' or 'keep'")
    found = base.stored(candidates(spark, path), "found")
    every = base.stored(placed(found), "placed")
    kept = base.stored(reachable(every), "kept")
    if broken == "raise" and (bad := unreached(found, kept).orderBy("file").limit(5).collect()):
        raise ValueError("records end before their file does: " + "; ".join(f"{r['file']} at byte {r['reached']} of {r['bytes']}" for r in bad))
    torn = kept.filter("length > 0 and digest is null").select("file", "offset", F.col("offset").alias("start"), (F.col("offset") + len(MAGIC) + F.col("cut") + 3).alias("begin"), "length")
    if torn.limit(1).count():
        raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))
        owner = _pieces(every, torn)
        parts = raw.join(owner, ["file", "block", "at"]).select("file", "start", "begin", "length", "offset", F.concat(F.lit(MAGIC).cast("binary"), F.col("value")).alias("value"))
        joined = parts.groupBy("file", "start").agg(F.first("begin").alias("begin"), F.first("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
        text = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["value"]))
        whole = joined.withColumn("text", text).select("file", F.col("start").alias("offset"), F.sha1(F.expr("substring(text, cast(begin - start + 1 as int), cast(length as int))")).alias("_digest"))
        kept = kept.join(whole, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "_digest")).drop("_digest")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) as bigint)")
    kept = kept.select(number("id").alias("page_id"), F.col("length").alias("n"), "digest", "type", number("refers").alias("refers_to"), F.regexp_extract("told", "^sha1:([0-9a-f]{40})$", 1).alias("told"))
    # A revisit takes length and digest from the response it names, if that has the payload it tells of.
    full = kept.filter("type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("told"), F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    named = kept.filter("type = 'revisit'").select("refers_to", "told").distinct()
    full = full.join(named, ["refers_to", "told"], "left_semi").dropDuplicates(["refers_to", "told"])
    again = F.col("type") == "revisit"
    out = kept.join(full, ["refers_to", "told"], "left")
    return out.select("page_id", F.when(again, F.col("_n")).otherwise(F.col("n")).cast("long").alias("payload_bytes"), F.when(again, F.col("_digest")).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def _pieces(every: DataFrame, torn: DataFrame) -> DataFrame:
    """file, block, at, offset of each candidate inside a torn record, with the record's start, begin and length."""
    events = every.select("file", "block", "at", "offset", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("length"))
    marks = torn.select("file", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("at"), "offset", "start", "begin", "length")
    order = Window.partitionBy("file").orderBy("offset", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = events.unionByName(marks).withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("start", "begin", "length")})
    return last.filter("at is not null and offset < begin + length").select("file", "block", "at", "offset", "start", "begin", "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{base.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(base.table(spark, sf_dir, "pages"), path)
    return read(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
    CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m"""
