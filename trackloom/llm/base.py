"""Shared pieces of the training-data operators: tables, vectorised word splitting over Arrow batches, shingle hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components as components
from ..shipping import map_arrow as map_arrow
from ..storage import discard as discard
from ..storage import scratch as scratch
from ..storage import shared_dir as shared_dir
from ..storage import stored as stored

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

#: Most bytes of rows that are sent to every executor; a larger side is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def sendable(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its rows are counted and few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        at = 0
        parts = np.cumsum(sizes) // most
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(parts, parts[at], side="right")))
            yield batch.slice(at, end - at)
            at = end


def hash_word(word: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Words:
    """The words of a slice of texts: `codes` into `names` (distinct words), cut into texts by `starts`."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        full = np.asarray(pc.binary_length(flat)) > 0 if len(flat) else np.zeros(0, bool)
        if not full.all():
            flat = flat.filter(pa.array(full))
        self.starts = np.concatenate([[0], np.cumsum(full)])[offsets]
        encoded = flat.dictionary_encode()
        self.codes = np.asarray(encoded.indices).astype(np.int64)
        # A-Z only. Not on the texts: that kernel is wrong on slices of arrays. Names may then be equal, their hashes too.
        self.names = pc.ascii_lower(encoded.dictionary) if lower else encoded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, alike in every process."""
        own = np.fromiter((hash_word(w) for w in self.names.to_pylist()), np.uint64, len(self.names))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The rolling polynomial (Karp-Rabin) hash, modulo 2**64, of each window of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    rolled = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        rolled = rolled * _M1 + hashes[k : len(hashes) - n + 1 + k]
    return mix(rolled)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; a shorter text is one shingle, an empty one none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    if len(hashes) < n:
        return gram_hashes(hashes, len(hashes))
    return np.unique(gram_hashes(hashes, n))
