"""Spelling variant grouping: every word of the corpus points to the far more frequent word that is one edit away, if there is one.

Words are counted by DataFrame functions. The vocabulary is range-partitioned, and each task packs its words into compact trie
shards: a radix tree in three integer arrays and one string, whose edges are stretches of the sorted words. Shards are broadcast in
turns of a bounded number of bytes. In each turn the automaton of all strings within one edit of a word walks every shard of
the turn depth-first, along the word itself until it leaves it, and after that along the one spelling each edit still allows;
accepting ends are neighbours, each found once. A turn gives the number of neighbours and the best of them for each word,
and the turns are reduced. So no task holds more of the vocabulary than one turn's shards, and none holds a group of variants.

Defined results: a null text has no words; a null id counts as empty text where runs are drawn for the deletion. Rows are
counted one by one, so repeated rows count again. Of best neighbours of equal count the smallest in code-point order is taken.
Chains of forms end, as each form is `ratio` times as frequent as the word before it (ratio above one). An empty table, or
one without words of the least length, gives an empty one. Extra columns are not read. Texts are read whole, and words have
any length. Lower-casing is from A to Z alone.
"""

from __future__ import annotations

import string
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

LETTERS = r"a-zÀ-ÿ"
#: Least code points of a word, least occurrences, and how many times as frequent a form is.
LEAST, OCCURRENCES, RATIO = 7, 2, 10
#: One in so many runs loses a code point, chosen by a hash of document and run.
DELETED = 31
#: Words, and code points, of a shard; a longer word has a shard of its own. Bytes of the shards of a turn.
SHARD, SHARD_POINTS = 200_000, 8_000_000
TURN_BYTES = 16 << 20
#: Words that one task walks with.
WALKED = 20_000


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, deleted: int | None = DELETED) -> DataFrame:
    """word, n: the words of `least` code points with so many occurrences.

    A run of letters whose checksum with its document's id is a multiple of `deleted` loses the code point that the checksum
    names. Shorter runs cannot become words, so only runs of `least` letters are taken.
    """
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    if deleted:
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
        cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
        runs = runs.select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run")).alias("run"))
        runs = runs.filter(F.length("run") >= least)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def _shared(a: str, b: str) -> int:
    """The length of the common beginning."""
    k, most = 0, min(len(a), len(b))
    while k < most:
        if a[k] != b[k]:
            return k
        k += 1
    return most


class Trie:
    """A radix tree over sorted distinct words. The nodes are in order of breadth, so the children of a node stand in a row.

    `low` is the first word under a node, `depth` the length all words under it share, `first` its first child, and `heads`
    holds the letter by which each node hangs from its parent.
    """

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        shared = np.fromiter((_shared(a, b) for a, b in zip(words, words[1:])), np.int64, max(len(words) - 1, 0))  # noqa: B905
        low, depth, first, heads, queue, at = [], [], [], [" "], [(0, len(words))], 0
        while at < len(queue):
            start, end = queue[at]
            low.append(start)
            first.append(len(queue))
            if end - start == 1:
                depth.append(len(words[start]))
            else:
                between = shared[start : end - 1]
                d = int(between.min())
                depth.append(d)
                cuts = [start, *(start + 1 + np.flatnonzero(between == d)).tolist(), end]
                for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                    if len(words[a]) > d:  # else it ends in this node
                        queue.append((a, b))
                        heads.append(words[a][d])
            at += 1
        first.append(len(queue))
        self.low, self.depth, self.first, self.heads = low, depth, first, "".join(heads)

    def packed(self) -> bytes:
        lengths = [len(x) for x in self.words]
        parts = (np.array(self.counts, np.int64).tobytes(), *(np.array(x, np.int32).tobytes() for x in (self.low, self.depth, self.first, lengths)), self.heads.encode(), "".join(self.words).encode())
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        me, at, parts = cls.__new__(cls), 56, []
        for size in np.frombuffer(data, np.int64, 7).tolist():
            parts.append(data[at : at + size])
            at += size
        me.counts = array("q", parts[0])
        me.low, me.depth, me.first = (array("i", x) for x in parts[1:4])
        text, ends = parts[6].decode(), np.cumsum(np.frombuffer(parts[4], np.int32)).tolist()
        me.heads, me.words = parts[5].decode(), [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return me

    def _straight(self, node: int, word: str, at: int, shift: int) -> int:
        """The number of the word under `node` that goes on as word[at + shift:] after `at` letters, else -1."""
        size = len(word) - shift
        depth, first, heads = self.depth, self.first, self.heads
        while (d := depth[node]) < size:
            node = heads.find(word[d + shift], first[node], first[node + 1])
            if node < 0:
                return -1
        found = self.low[node]
        return found if d == size and self.words[found][at:] == word[at + shift :] else -1

    def _edits(self, node: int, word: str, at: int, out: list[int]) -> None:
        """Neighbours under a node that leaves the word after `at` letters by another letter: replaced, inserted or deleted there."""
        size, text = len(word), self.words[self.low[node]]
        deleted = at + 1 < size and word[at + 1] == text[at]
        if self.depth[node] > at + 1:  # the next letter of all words below, which rules most edits out
            after = text[at + 1]
            replaced, inserted = at + 1 < size and word[at + 1] == after, at < size and word[at] == after
            deleted = deleted and at + 2 < size and word[at + 2] == after
        else:
            replaced, inserted = at < size, True
        if replaced and (found := self._straight(node, word, at + 1, 0)) >= 0:
            out.append(found)
        if inserted and (found := self._straight(node, word, at + 1, -1)) >= 0:
            out.append(found)
        if deleted and (found := self._straight(node, word, at + 1, 1)) >= 0:
            out.append(found)

    def near(self, word: str) -> list[int]:
        """Numbers of the words at an edit distance of exactly one.

        A neighbour's edit can always be put where it first differs from the word. So the walk follows the word itself, and
        at each branch that leaves it one edit is spent, after which a single path remains.
        """
        node, at, size, out = 0, 0, len(word), []
        words, low, depth, first, heads = self.words, self.low, self.depth, self.first, self.heads
        while True:
            text, end = words[low[node]], depth[node]
            if text[at:end] != word[at:end]:  # the edge leaves the word, or goes on after its end
                self._edits(node, word, at + _shared(text[at:end], word[at:end]), out)
                return out
            at = end
            if at == size - 1 and len(text) == at:
                out.append(low[node])  # the word without its last letter
            onward, begin, end = -1, first[node], first[node + 1]
            letter, after = word[at : at + 1], word[at + 1 : at + 2]
            for child in range(begin, end):
                head = heads[child]
                if head == letter:
                    onward = child
                elif depth[child] > at + 1 or head == after:
                    self._edits(child, word, at, out)
                else:  # no deletion; a replaced or an inserted letter, if the next one is there
                    a, b = first[child], first[child + 1]
                    if after and heads.find(after, a, b) >= 0 and (found := self._straight(child, word, at + 1, 0)) >= 0:
                        out.append(found)
                    if letter and heads.find(letter, a, b) >= 0 and (found := self._straight(child, word, at + 1, -1)) >= 0:
                        out.append(found)
                    if not after and len(words[low[child]]) == at + 1 and at + 1 in (size, size + 1):  # the last letter replaced, or one put after it
                        out.append(low[child])
            if onward < 0:
                return out
            node = onward


def shards(words: DataFrame, count: int) -> DataFrame:
    """low (its first word), size, trie: the vocabulary in compact shards of neighbouring words."""

    def run(batches):
        some, counts, points = [], [], 0

        def done():
            data = Trie(some, counts).packed()
            return pa.RecordBatch.from_arrays([pa.array([some[0]]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["low", "size", "trie"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if some and (len(some) >= SHARD or points + len(word) > SHARD_POINTS):
                    yield done()
                    some, counts, points = [], [], 0
                some.append(word)
                counts.append(n)
                points += len(word)
        if some:
            yield done()

    dealt = words.select("word", "n").repartitionByRange(max(1, -(-count // SHARD)), "word").sortWithinPartitions("word")
    return base.map_arrow(dealt, run, "low string, size long, trie binary")


_opened: dict[str, list[Trie]] = {}


def _tries(name: str, sent) -> list[Trie]:
    """The shards of a turn, unpacked once in each worker."""
    if name not in _opened:
        _opened.clear()
        _opened[name] = [Trie.unpacked(x) for x in sent.value]
    return _opened[name]


def _turns(sizes: list[tuple[str, int]], most: int) -> list[tuple[str, str]]:
    """First and last shard of each turn: shards in order, as many as the bytes allow, one at least."""
    out, held = [], 0
    for low, size in sizes:
        if out and held + size <= most:
            out[-1] = (out[-1][0], low)
            held += size
        else:
            out.append((low, low))
            held = size
    return out


def neighbours(words: DataFrame, most: int = TURN_BYTES) -> DataFrame:
    """word, n_near, best (the neighbour of largest n), best_n of the words that have a neighbour. `words` is a stored table (word, n)."""
    spark = words.sparkSession
    count = words.count()
    cut = base.stored(shards(words, count), "shards")
    sizes = sorted((r["low"], r["size"]) for r in cut.select("low", "size").collect())  # one row for some hundred thousand words
    parts = max(spark.sparkContext.defaultParallelism, -(-count // WALKED))
    dealt = base.stored(words.select("word").repartition(parts), "walkers") if sizes else None
    found = []
    for low, high in _turns(sizes, most):
        turn = [bytes(r["trie"]) for r in cut.filter(F.col("low").between(low, high)).orderBy("low").select("trie").collect()]
        sent = spark.sparkContext.broadcast(turn)

        def run(batches, sent=sent, name=uuid.uuid4().hex):
            tries = _tries(name, sent)
            for batch in batches:
                rows = []
                for word in batch.column(0).to_pylist():
                    many, best_n, best = 0, 0, None
                    for trie in tries:
                        counts = trie.counts
                        for k in trie.near(word):
                            many += 1
                            if counts[k] > best_n or counts[k] == best_n and trie.words[k] < best:
                                best_n, best = counts[k], trie.words[k]
                    if many:
                        rows.append((word, many, best, best_n))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n_near", "best", "best_n"])

        found.append(base.stored(base.map_arrow(dealt, run, "word string, n_near long, best string, best_n long"), "near"))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if len(found) == 1:
        return out
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a stored table (word, form): the last form that each chain reaches. Jumps double in each round."""
    jumps = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = base.stored(jumps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        jumps = moved.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO, most: int = TURN_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a table (word, n)."""
    words = base.stored(words, "words")
    found = neighbours(words, most)
    better = F.col("best_n") >= F.col("n") * ratio
    rows = words.join(found, "word", "left").select(
        "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best_n")).alias("form_n")
    )
    rows = base.stored(rows, "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(base.table(spark, sf_dir, "documents")))
