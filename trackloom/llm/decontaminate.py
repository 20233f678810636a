"""Benchmark decontamination by greedy string tiling: windows of LEAST words that a document shares with a test item are
the seeds; within the seeded stretches the longest common runs of words not marked yet are marked again and again, found by
running Karp-Rabin hashes; a document is contaminated if the tiles cover at least THRESHOLD of an item, in whatever order.

The test items are a stated query set: they go to all executors in blocks of at most BLOCK_WORDS words, and every document
meets every block, so a benchmark of any size takes bounded memory. Words are compared in lower case without punctuation.

Defined results: a null or empty text or item has no words and matches nothing; so does an item of fewer than LEAST words.
Ties between tiles of one length go to the earliest place in the document, then in the item; between items, to the smaller
item_id. Rows of one doc_id share the verdict of `judge`; repeated items (one id) are tiled each by itself. Empty tables give no contaminated rows. Extra columns
pass through the filter. Texts are tiled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import base

LEAST = 5
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
#: Places of seeds in items that are looked at together, but for a single text with more.
SEEDS = 2_000_000
_FACTOR = 0x9E3779B97F4A7C15
_PUNCTUATION = r"[\p{P}\p{S}]+"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text without case and punctuation, and where each text starts."""
    split = base.Words(texts)
    names = pc.replace_substring_regex(pc.utf8_lower(split.names), _PUNCTUATION, "")
    own = np.fromiter((base.hash_word(w) for w in names.to_pylist()), np.uint64, len(names))
    full = np.asarray(pc.binary_length(names)).astype(np.int64) > 0
    if not len(own):
        return np.zeros(0, np.uint64), split.starts
    keep = full[split.codes]
    return own[split.codes][keep], np.concatenate([[0], np.cumsum(keep)])[split.starts]


class Running:
    """Karp-Rabin hashes, modulo 2**64, of all windows of any length of a sequence, by prefix sums."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n = len(words)
        inverse = pow(_FACTOR, -1, 1 << 64)
        self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _FACTOR, np.uint64))]).astype(np.uint64)
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), inverse, np.uint64))]).astype(np.uint64)[:n]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * down, dtype=np.uint64)]).astype(np.uint64)

    def windows(self, size: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of `size` words none of which is used."""
        marked = np.concatenate([[0], np.cumsum(used)])
        at = np.flatnonzero(marked[size:] == marked[:-size])
        return at, (self.sums[at + size] - self.sums[at]) * self.up[at]


def _matches(a: Running, b: Running, used_a, used_b, size: int):
    """Windows of a whose hash some window of b has: their places, the group of each in b, and the places of the groups, rising."""
    at_a, hash_a = a.windows(size, used_a)
    at_b, hash_b = b.windows(size, used_b)
    order = np.argsort(hash_b, kind="stable")
    low, high = (np.searchsorted(hash_b[order], hash_a, side=s) for s in ("left", "right"))
    hit = np.flatnonzero(high > low)
    return at_a[hit].tolist(), low[hit].tolist(), high[hit].tolist(), at_b[order].tolist()


def _equal(a: Running, b: Running, i: int, j: int, size: int) -> bool:
    return bool((a.words[i : i + size] == b.words[j : j + size]).all())


def tiles(document: np.ndarray, item: np.ndarray, free: np.ndarray | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in document, place in item, length), longest first. `free`: words that may match.

    Tiles of one length are marked while the document is passed once. Places of the item that a tile covers are covered for
    good, so each group of equal windows is passed once too, however often a passage repeats.
    """
    a, b = Running(document), Running(item)
    used_a = np.zeros(len(document), bool) if free is None else ~free
    used_b, out = np.zeros(len(item), bool), []
    top = min(len(document), len(item))
    while top >= least:
        low, high = least - 1, top
        while low < high:  # whether windows of a length are shared only turns from yes to no
            size = (low + high + 1) // 2
            places, firsts, _, others = _matches(a, b, used_a, used_b, size)
            if any(_equal(a, b, i, others[x], size) for i, x in zip(places, firsts, strict=True)):
                low = size
            else:
                high = size - 1
        if low < least:
            break
        places, firsts, ends, others = _matches(a, b, used_a, used_b, low)
        passed: dict[int, int] = {}  # of each group, how many places are covered
        until = 0
        for i, x, y in zip(places, firsts, ends, strict=True):
            if i < until:
                continue
            k = passed.get(x, x)
            while k < y and (used_b[others[k]] or used_b[others[k] + low - 1]):
                k += 1
            passed[x] = k
            if k < y and _equal(a, b, i, others[k], low):
                j = others[k]
                used_a[i : i + low] = used_b[j : j + low] = True
                out.append((i, j, low))
                until = i + low
        top = low if len(out) and out[-1][2] == low else low - 1
    return out


class Items:
    """A block of test items: their words, and the seeds with the item and place each stands for."""

    def __init__(self, ids: list, hashes: np.ndarray, starts: np.ndarray):
        self.ids, self.starts, self.hashes = ids, starts, hashes
        grams = base.gram_hashes(hashes, LEAST)
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        at = np.flatnonzero(owner[: len(grams)] == owner[LEAST - 1 :]) if len(grams) else np.zeros(0, np.int64)
        order = at[np.argsort(grams[at], kind="stable")]
        self.grams, self.place, self.owner = grams[order], order, owner[order] if len(order) else order
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def search(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, words covered, words of the item) where the tiles reach the threshold."""
        grams = base.gram_hashes(words, LEAST)
        if not len(grams) or not len(self.grams):
            return []
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        hit = np.flatnonzero(self.near[(grams >> np.uint64(44)).astype(np.int64)])
        low, high = (np.searchsorted(self.grams, grams[hit], side=s) for s in ("left", "right"))
        inside = (high > low) & (text[hit] == text[hit + LEAST - 1])
        hit, low, high = hit[inside], low[inside], high[inside]
        if not len(hit):
            return []
        # Equal seeds of a text count once: they cover the same words of the items.
        order = np.lexsort((low, text[hit]))
        hit, low, high = hit[order], low[order], high[order]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[hit][1:] != text[hit][:-1])]))
        owner, many, ends = text[hit[new]], (high - low)[new], np.append(new[1:], len(hit))
        texts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out, from_ = [], 0
        for x, y in zip(texts, np.append(texts[1:], len(owner)), strict=True):  # so many texts at once as have SEEDS seeds in items
            if y == len(owner) or many[from_:y].sum() > SEEDS:
                out += self._judged(words, starts, hit, owner[from_:y], low[new][from_:y], many[from_:y], new[from_:y], ends[from_:y])
                from_ = y
        return out

    def _judged(self, words, starts, hit, owner, low, many, first, end) -> list[tuple[int, int, int, int]]:
        which = np.repeat(np.arange(len(owner)), many)
        seed = np.repeat(low - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(many.sum())
        pair = owner[which] * len(self.ids) + self.owner[seed]
        order = np.argsort(pair, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
        out, spread = [], np.arange(LEAST)
        for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[x:y]
            t, k = divmod(int(pair[own[0]]), len(self.ids))
            size = int(self.starts[k + 1] - self.starts[k])
            # Tiles lie where seeds lie, so seeds that cover too little of the item end the search.
            if len(np.unique(self.place[seed[own]][:, None] + spread)) < THRESHOLD * size:
                continue
            at = np.concatenate([hit[first[g] : end[g]] for g in np.unique(which[own]).tolist()])
            places = np.unique(at[:, None] + spread)
            stretch = words[places[0] : places[-1] + 1]
            free = np.zeros(len(stretch), bool)
            free[places - places[0]] = True
            gap = np.concatenate([[0], np.flatnonzero(~free)])
            if len(gap) > 1:  # leave out the words between seeded stretches, but for one that parts them
                keep = free.copy()
                keep[gap[1:][np.concatenate([[True], np.diff(gap[1:]) > 1])]] = True
                stretch, free = stretch[keep], free[keep]
            covered = sum(n for _, _, n in tiles(stretch, self.hashes[self.starts[k] : self.starts[k + 1]], free))
            if covered >= THRESHOLD * size:
                out.append((t, k, covered, size))
        return out


def blocks(benchmark: DataFrame, most: int | None = None):
    """The items in blocks of bounded size, one block at a time on the driver."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    bytes_, here, size = 8 * (most or BLOCK_WORDS), [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        here.append(row)
        size += len(row.text)
        if size >= bytes_:
            yield here
            here, size = [], 0
    if here:
        yield here


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, item_id, covered, item_words: the pairs whose tiles cover at least THRESHOLD of the item."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(key).alias("_key"), F.col(f"`{text}`").alias("text"))
    kind = benchmark.schema["item_id"].dataType
    schema = f"_key {docs.schema[key].dataType.simpleString()}, item_id {kind.simpleString()}, covered long, item_words long"
    for block in blocks(benchmark):
        items = Items([r.item_id for r in block], *plain_words(pa.array([r.text for r in block], pa.string())))
        sent = spark.sparkContext.broadcast((items.ids, items.hashes, items.starts))

        def run(batches, sent=sent):
            items = Items(*sent.value)
            for batch in base.slices(batches):
                found = items.search(*plain_words(batch.column("text")))
                if found:
                    t, k, covered, size = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(t)), pa.array([items.ids[x] for x in k], to_arrow_type(kind)), pa.array(covered, pa.int64()), pa.array(size, pa.int64())], names=["_key", "item_id", "covered", "item_words"])

        one = base.map_arrow(rows, run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.filter("false").select("_key", F.lit(None).cast(kind).alias("item_id"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("item_words"))
    return out.withColumnRenamed("_key", key)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, coverage (most of an item's words that are covered, as a share), n_items, items: one row per row of docs.

    A document's own pairs meet in its task; documents and their verdicts meet by a join on the small side of the found pairs.
    """
    found = leaks(docs, benchmark).withColumn("share", F.try_divide("covered", "item_words"))
    found = base.stored(found.groupBy("doc_id").agg(F.max("share").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("items")), "leaks")
    rows = docs.select("doc_id").alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return rows.select("d.doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows, each judged by its own text where it is scanned; nothing is shuffled."""
    kept, last = docs.schema, docs
    for block in blocks(benchmark):
        items = Items([r.item_id for r in block], *plain_words(pa.array([r.text for r in block], pa.string())))
        sent = docs.sparkSession.sparkContext.broadcast((items.ids, items.hashes, items.starts))

        def run(batches, sent=sent):
            items = Items(*sent.value)
            for batch in base.slices(batches):
                bad = {t for t, *_ in items.search(*plain_words(batch.column("text")))}
                yield batch.filter(pa.array([t not in bad for t in range(batch.num_rows)], pa.bool_())) if bad else batch

        last = base.map_arrow(last, run, kept)
    return last


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(base.table(spark, sf_dir, "documents").select("doc_id", "text"), base.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    return clean(docs, base.table(spark, sf_dir, "benchmark"))
