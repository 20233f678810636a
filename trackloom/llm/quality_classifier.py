"""Quality classifier: two zstandard dictionaries, one built from good and one from bad labelled text, compress every
block of a document; the difference of the two sizes, over the size of the text, is calibrated to a probability.

Defined results: a null or empty text has difference 0 and the calibrated score of 0; repeated rows are scored alike; with
no labelled rows of one class, every score is the share of label 1 (0.5 without labels). Extra columns pass through; an
input column with the name of the output is replaced. Texts are compressed whole, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

BLOCK, DICTIONARY, LEVEL = 512, 112_640, 3
#: Bounds of what is learned from: labelled rows of each class for each purpose, and blocks of each class.
LABELLED, BLOCKS = 2000, 8000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: Differences and the share of label 1 at each; both rise.
    at: tuple[float, ...]
    share: tuple[float, ...]

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return np.interp(difference, self.at, self.share)


def blocks(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]


def compressors(good: bytes, bad: bytes) -> list:
    made = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))
    return made


def difference(text: bytes, good, bad) -> float:
    """Normalised compressed-size difference: positive if the good dictionary fits better."""
    parts = blocks(text)
    return sum(len(bad.compress(x)) - len(good.compress(x)) for x in parts) / max(1, len(text))


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:] or b" " * 8


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic calibration: shares of label 1 that rise with the difference, by pooling neighbours that fall; smoothed by one row of
    either label, and straight between the means of the pools."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # rows, rows of label 1, sum of x
    for at, one in zip(x[order], y[order], strict=True):
        pools.append([1, float(one), float(at)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    n, ones, total = np.array(pools).T
    share = np.maximum.accumulate((ones + 1) / (n + 2))
    return tuple((total / n).tolist()), tuple(share.tolist())


def fit(docs: DataFrame, labels: DataFrame, learn=None, labelled: int = LABELLED, most_blocks: int = BLOCKS) -> Model:
    """Learn from labels (doc_id, quality) where the Column `learn` holds (default: all).

    Dictionaries learn from one half of the rows and the calibration from the other. The halves are the `labelled` rows
    of each class with the least hash; so what is broadcast and collected is bounded whatever the tables' size. Where the
    calibration's half holds one label only, the score rises straight from 0 at a difference of -0.1 to 1 at 0.1.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    own = own.filter(learn(F.col("_id")) if learn else F.lit(True))
    spread = F.xxhash64(F.col("_id"), F.lit("sample"))
    chosen = None
    for label in (0, 1):
        some = own.filter(F.col("_label") == label).withColumn("_at", spread).orderBy("_at", "_id").limit(2 * labelled)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.withColumn("_use", F.pmod(F.xxhash64(F.col("_id"), F.lit("half")), F.lit(2)))
    texts = docs.select(F.col("doc_id").alias("_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_text")).join(F.broadcast(chosen), "_id")
    texts = base.stored(texts, "labelled")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("_text") - 1) / BLOCK).cast("int")), lambda k: F.struct(k.alias("k"), F.substring(F.col("_text"), k * BLOCK + 1, F.lit(BLOCK)).alias("b"))))
    pool = texts.filter("_use = 0 and octet_length(_text) > 0").select("_id", "_label", cut.alias("x")).select("_label", "x.b", F.xxhash64("_id", "x.k").alias("_at"))
    parts = {label: [bytes(r.b) for r in pool.filter(F.col("_label") == label).orderBy("_at", "b").limit(most_blocks).select("b").collect()] for label in (0, 1)}
    if not parts[0] or not parts[1]:
        row = own.agg(F.sum("_label"), F.count("*")).first()
        share = (row[0] / row[1]) if row[1] else 0.5
        return Model(b" " * 8, b" " * 8, (0.0,), (float(share),))
    good, bad = dictionary(parts[1]), dictionary(parts[0])
    # One text of each labelled doc_id, so no doc_id of many rows takes the place of others: 4 * labelled rows at most.
    one = texts.filter("_use = 1").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    seen = scored(one.select("_label", F.col("_text").cast("string").alias("text")), Model(good, bad, (), ()), raw="_difference").select("_label", "_difference").toArrow()
    x, y = seen.column("_difference").to_numpy().astype(float), seen.column("_label").to_numpy().astype(int)
    if len(set(y)) < 2:
        return Model(good, bad, (-0.1, 0.1), (0.0, 1.0))
    return Model(good, bad, *calibrate(x, y))


def scored(docs: DataFrame, model: Model, text: str = "text", output: str = "score", raw: str | None = None) -> DataFrame:
    """`docs` with the score (or, named by `raw`, the difference) of each whole text."""
    name = raw or output
    kept = [f for f in docs.schema.fields if f.name != name]

    def run(batches):
        good, bad = compressors(model.good, model.bad)
        for batch in base.slices(batches, text):
            values = np.array([difference((x.as_py() or "").encode(), good, bad) for x in batch.column(text)], float)
            values = values if raw else model.probability(values)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(values)], names=[f.name for f in kept] + [name])

    return base.map_arrow(docs, run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def fold(doc_id):
    """The hold-out fold of a row: crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false without a doc_id), score, predicted of every document."""
    model = fit(docs, labels, learn=lambda doc_id: fold(doc_id) != 0)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = fit(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"), learn=lambda doc_id: fold(doc_id) != 0)
    name = base.free(docs, "_score")
    return scored(docs, model, output=name).filter(F.col(name) >= THRESHOLD).drop(name)
