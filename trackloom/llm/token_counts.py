"""Token counts: documents are aggregated by their encoded length into an exact histogram; suffix sums over the lengths
answer totals, quantiles and truncated totals for every context limit.

Defined results: a null or empty text has length 0 and counts as a document; repeated rows count each; an empty table
gives an empty histogram. Texts are encoded whole. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of one block of the two-level suffix sums.
SPAN = 1024
_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs. Each task counts its own lengths first, so at most a row per length and task is shuffled."""

    def run(batches):
        encode, seen = encoder(vocabulary).encode_ordinary, Counter()
        for batch in base.slices(batches, text):
            seen.update(len(encode(x.as_py() or "")) for x in batch.column(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return base.map_arrow(docs.select(text), run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: documents and tokens in all, documents that fit, documents longer
    and the tokens left when every document is cut at the limit.

    Sums run within blocks of SPAN lengths and over the totals of the blocks, so that no task sorts all lengths.
    """
    hist = base.stored(hist, "lengths").withColumn("_block", F.floor(F.col("n_tokens") / SPAN))
    tokens = F.col("n_docs") * F.col("n_tokens")
    totals = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_d", "_t")), *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("_d", "_t")))
    inside = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({"_d": F.sum("n_docs").over(inside), "_t": F.sum(tokens).over(inside)}).join(totals, "_block")
    fit, short = F.col("_d") + F.col("_d_before"), F.col("_t") + F.col("_t_before")
    return out.select("n_tokens", "n_docs", fit.alias("docs_fitting"), (F.col("_d_all") - fit).alias("docs_longer"), F.col("_t_all").alias("tokens_total"), (short + (F.col("_d_all") - fit) * F.col("n_tokens")).alias("tokens_truncated"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length within which at least that share of the documents fits."""
    out = None
    for share in shares:
        one = sums.filter(F.col("docs_fitting") >= F.lit(float(share)) * (F.col("docs_fitting") + F.col("docs_longer"))).agg(F.min("n_tokens").alias("n_tokens")).select(F.lit(float(share)).alias("share"), "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def truncated(sums: DataFrame, limit: int) -> DataFrame:
    """tokens: what is left when every document is cut at `limit`, which need not be a length that occurs."""
    below = F.col("n_tokens") <= limit
    cut = F.coalesce(F.sum(F.when(below, F.col("n_docs") * F.col("n_tokens"))), F.lit(0)) + limit * F.coalesce(F.sum(F.when(~below, F.col("n_docs"))), F.lit(0))
    return sums.agg(cut.alias("tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(base.table(spark, sf_dir, "documents")))
