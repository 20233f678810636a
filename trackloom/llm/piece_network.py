"""Language-model scoring by masked pseudo-likelihood over the pieces of a public subword vocabulary: a network predicts every
piece of a text from SIDE pieces to each side, and the summed conditional log-probabilities score the document.

The vocabulary covers any text (bytes stand for what it has no piece for), so no word is left out or shares a class. The query
encodes each text once (`coded`); training and scoring take texts, or a binary column of pieces. Pieces are the leaves of a tree
of FAN branches; a softmax at each of its three levels gives a piece's probability as the product along its path, and the
probabilities of all pieces add up to one.

Every document trains. Texts (or their pieces) are dealt into parts of about PART bytes and ordered within them by their hashes, so that one corpus
gives one model however its table is cut; copies of a text are numbered and dealt apart. Tasks descend over the texts of their part
(Adagrad) from common weights and hand on what moved, each row of weights times the number of pieces it was trained on; shuffles add
the moves up block by block, ADDED parts at a time, and the driver divides by the counts. A first round over an eighth of the texts,
chosen by hash, brings the weights near, a second runs over all. Given the weights, a text's score depends on the text alone.

Defined results: a null or empty text has no tokens, score 0 and no mean; repeated rows are scored alike; an empty table trains
on nothing and gives an empty result. Extra columns pass through `scored`; an input column with the name of an output is
replaced. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_groups
from . import base

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SIDE, WIDTH, FAN, LEVELS = 3, 24, 32, (10, 5, 0)
RATE, FIRST = 0.08, 8
#: Pieces in a step of training, at first and at most (doubled every DOUBLED steps), and in a step of scoring.
LEAST, MOST, DOUBLED, SCORED = 4096, 16384, 24, 16384
#: Pieces whose hidden layer is made at once, so that it stays in a processor's cache.
CACHED = 512
#: Pieces whose softmaxes are worked on at once, for the same reason.
TRAINED = 2048
#: Numbers in a block of moves, and parts whose moves are added up at once.
BLOCK, ADDED = 4096, 64
#: Bytes of text, or of pieces, in a part.
PART = 16 << 20
#: Least share of a branch, so that no score is infinite.
TINY = 1e-37
#: Words whose pieces a process remembers, and the longest remembered, in bytes.
REMEMBERED, SHORT = 300_000, 40
MOVES = "part long, block int, data binary"
SHIFTS = [k for k in range(-SIDE, SIDE + 1) if k]
_loaded: dict = {}


class Pieces:
    """A vocabulary, with the leaf of each piece: starts of words first, then by their endings."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.edge = self.processor.get_piece_size()
        if self.size > FAN**3 - 1:
            raise ValueError(f"{path}: more than {FAN**3 - 1} pieces")
        names = [self.processor.id_to_piece(k) for k in range(self.size)]
        self.leaf = np.zeros(self.size + 1, np.int16)
        self.memory: dict[str, bytes] = {}
        self.leaf[sorted(range(self.size), key=lambda k: (not names[k].startswith("▁"), names[k][::-1], k))] = np.arange(self.size)

    def words(self, names: list[str]) -> list[bytes]:
        """The pieces of each word, as the bytes of 16-bit numbers."""
        if len(self.memory) + len(names) > REMEMBERED:
            self.memory.clear()
        out = [self.memory.get(x) for x in names]
        new = [k for k, x in enumerate(out) if x is None]
        coded = self.processor.encode([names[k] for k in new], num_threads=1) if new else []
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) * 2).tolist()
        raw = np.fromiter(chain.from_iterable(coded), np.int16).tobytes()
        for k, a, b in zip(new, [0, *ends], ends):
            out[k] = raw[a:b]
            if len(names[k]) <= SHORT:
                self.memory[names[k]] = out[k]
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of a slice of texts, or of pieces as `coded` returns them, in a row; the number of each text's pieces."""
        if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
            held = pc.fill_null(texts.cast(pa.large_binary()), b"")
            ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset :][: len(held) + 1]
            data = held.buffers()[2]
            whole = np.frombuffer(data, np.int16, (ends[-1] - ends[0]) // 2, ends[0]) if data and ends[-1] > ends[0] else np.zeros(0, np.int16)
            return whole, np.diff(ends) // 2
        split = base.Words(texts)
        coded = self.words(split.names.to_pylist())
        if not coded:
            return np.zeros(0, np.int16), np.zeros(len(texts), np.int64)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        flat = np.frombuffer(b"".join(coded), np.int16)
        each = size.take(split.codes)
        ends = np.concatenate([[0], np.cumsum(each)])
        first = np.cumsum(size) - size
        at = np.repeat((first.take(split.codes) - ends[:-1]).astype(np.int32), each)  # a slice has fewer pieces than 2**31
        at += np.arange(ends[-1], dtype=np.int32)
        return flat.take(at), np.diff(ends.take(split.starts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of a slice with SIDE edges before each text and after the last; where each text starts; its number of pieces."""
        flat, n = self.flat(texts)
        starts = np.cumsum(n) - n + SIDE * np.arange(1, len(n) + 1)
        inside = np.ones(len(flat) + SIDE * (len(n) + 1), bool)
        inside[(np.append(starts - SIDE, len(inside) - SIDE)[:, None] + np.arange(SIDE)).ravel()] = False
        ids = np.full(len(inside), self.edge, np.int16)
        ids[inside] = flat
        return ids, starts, n


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The distinct values of a sorted array, and where each begins, and the last ends."""
    cuts = [0, *(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).tolist(), len(sorted_)] if len(sorted_) else [0]
    return sorted_.take(cuts[:-1]), cuts


class Network:
    """An embedding of pieces, scaled by place and added up; tanh; a softmax at each node of the tree."""

    def __init__(self, size: int, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        nodes = [-(-size // (FAN << shift)) for shift in LEVELS]
        self.size = size
        self.embedding, self.place, self.hidden = normal(size + 1, WIDTH), 1 + normal(len(SHIFTS), WIDTH), np.zeros((1, WIDTH), np.float32)
        self.levels = [normal(n, WIDTH + 1, FAN) for n in nodes]
        for shift, n, w in zip(LEVELS, nodes, self.levels, strict=True):
            w[:, -1, :] = np.where(np.arange(n * FAN).reshape(n, FAN) << shift < size, 0, -1e4)  # no piece below

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.place, self.hidden, *self.levels]

    def places(self) -> np.ndarray:
        """The scales of each place, CACHED times: products of whole blocks take a third of the time of products with one row."""
        return np.repeat(self.place[:, None], CACHED, axis=1)

    def inner(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedding of each piece, and the hidden layer for all but SIDE pieces at either end."""
        x, many = self.embedding.take(ids, axis=0), len(ids) - 2 * SIDE
        h, held = np.empty((many, WIDTH), np.float32), np.empty((CACHED, WIDTH), np.float32)
        places, hidden = self.places(), np.repeat(self.hidden, CACHED, axis=0)
        for at in range(0, many, CACHED):
            part = h[at : at + CACHED]
            part[:] = hidden[: len(part)]
            for k, p in zip(SHIFTS, places, strict=True):
                part += np.multiply(x[at + SIDE + k :][: len(part)], p[: len(part)], out=held[: len(part)])
            np.tanh(part, out=part)
        return x, h

    def paths(self, h: np.ndarray, leaf: np.ndarray) -> Iterator[tuple]:
        """Level by level, for h in the order of leaves: node bounds, nodes, branches taken, probabilities of all branches."""
        for shift, w in zip(LEVELS, self.levels, strict=True):
            nodes, cuts = runs(leaf >> (shift + 5))
            p = np.empty((len(leaf), FAN), np.float32)
            for a, b, k in zip(cuts, cuts[1:], nodes.tolist()):
                np.dot(h[a:b], w[k], out=p[a:b])
            if p.max(initial=0) > 60 or p[:, 0].min(initial=0) < -60:  # the first branch always leads to a piece
                p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            yield cuts, nodes, (leaf >> shift) & (FAN - 1), p, p @ np.ones(FAN, np.float32)

    def ordered(self, ids: np.ndarray, h: np.ndarray, leaf_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that are no edge, in the order of their leaves: rows, hidden layer with a one, leaves."""
        middle = ids[SIDE : len(ids) - SIDE]
        rows = np.flatnonzero(middle != self.size)
        leaf = leaf_of.take(middle.take(rows))
        order = np.argsort(leaf, kind="stable")
        rows, leaf = rows.take(order), leaf.take(order)
        own = np.ones((len(rows), WIDTH + 1), np.float32)
        own[:, :WIDTH] = h.take(rows, axis=0)
        return rows, own, leaf

    def score(self, ids: np.ndarray, leaf_of: np.ndarray) -> np.ndarray:
        """Log-probability of each piece given its neighbours; 0 for edges and for the SIDE pieces at either end of ids."""
        out = np.zeros(len(ids))
        for at in range(SIDE, len(ids) - SIDE, SCORED):
            part = ids[at - SIDE : min(at + SCORED, len(ids) - SIDE) + SIDE]
            rows, own, leaf = self.ordered(part, self.inner(part)[1], leaf_of)
            for cut in range(0, len(rows), TRAINED):
                here, own_leaf = own[cut : cut + TRAINED], leaf[cut : cut + TRAINED]
                total, first = np.zeros(len(here)), np.arange(len(here)) * FAN
                for _, _, branch, p, whole in self.paths(here, own_leaf):
                    total += np.log(np.maximum(p.reshape(-1).take(first + branch), TINY) / whole)
                out[at + rows[cut : cut + TRAINED]] = total
        return out


class Descent:
    """A network in training: sums of squared gradients, and how many pieces each row of weights was trained on."""

    def __init__(self, net: Network, leaf_of: np.ndarray):
        self.net, self.leaf_of, self.steps = net, leaf_of, 0
        self.squares = [np.full(w.shape, 1e-6, np.float32) for w in net.weights()]
        self.counts = [np.zeros(len(w)) for w in net.weights()]
        self.held = np.zeros(0, np.int16)

    def move(self, k: int, rows, gradient: np.ndarray, n) -> None:
        squares = gradient * gradient
        squares += self.squares[k][rows]
        self.squares[k][rows] = squares
        np.sqrt(squares, out=squares)
        np.divide(gradient, squares, out=squares)
        squares *= RATE
        self.net.weights()[k][rows] -= squares
        self.counts[k][rows] += n

    def step(self, ids: np.ndarray) -> None:
        net, many = self.net, len(ids) - 2 * SIDE
        x, h = net.inner(ids)
        rows, own, leaf = net.ordered(ids, h, self.leaf_of)
        if not len(rows):
            return
        # In pieces that stay in the processor's cache; rows are in the order of leaves, so a node's rows lie side by side.
        back, first, held = np.empty((len(rows), WIDTH), np.float32), np.arange(TRAINED) * FAN, np.empty((TRAINED, WIDTH), np.float32)
        nodes, counts = zip(*((n, np.diff(cuts)) for n, cuts in (runs(leaf >> (shift + 5)) for shift in LEVELS)), strict=True)
        gradients = [np.zeros((len(n), WIDTH + 1, FAN), np.float32) for n in nodes]
        for at in range(0, len(rows), TRAINED):
            part, into = own[at : at + TRAINED], back[at : at + TRAINED]
            turned, out = part.T, into  # the first level's share is written in place, the others are added
            for w, gradient, known, (cuts, here, branch, p, whole) in zip(net.levels, gradients, nodes, net.paths(part, leaf[at : at + TRAINED]), strict=True):
                p *= (1 / whole)[:, None]
                p.reshape(-1)[first[: len(p)] + branch] -= 1
                j = int(np.searchsorted(known, here[0]))  # nodes of a part follow each other in those of the step
                for a, b, node in zip(cuts, cuts[1:], here.tolist()):
                    own_p = p[a:b]
                    gradient[j] += np.dot(turned[:, a:b], own_p)
                    np.dot(own_p, w[node, :WIDTH].T, out=out[a:b])
                    j += 1
                if out is not into:
                    into += out[: len(p)]
                out = held
        dh = np.zeros((many, WIDTH), np.float32)
        dh[rows] = back
        np.subtract(1, np.multiply(h, h, out=h), out=h)
        dh *= h
        dx, dp, places = np.zeros_like(x), np.zeros_like(net.place), net.places()
        held, ones = np.empty((CACHED, WIDTH), np.float32), np.ones(CACHED, np.float32)
        for at in range(0, many, CACHED):
            part = dh[at : at + CACHED]
            product, one = held[: len(part)], ones[: len(part)]
            for j, k in enumerate(SHIFTS):
                there = slice(at + SIDE + k, at + SIDE + k + len(part))
                dp[j] += one @ np.multiply(part, x[there], out=product)
                dx[there] += np.multiply(part, places[j, : len(part)], out=product)
        order = np.argsort(ids, kind="stable")
        known, cuts = runs(ids.take(order))
        self.move(0, known, np.add.reduceat(dx.take(order, axis=0), cuts[:-1]), np.diff(cuts))
        self.move(1, slice(None), dp, len(rows))
        self.move(2, slice(None), (np.ones(many, np.float32) @ dh)[None], len(rows))
        for k, m in enumerate(zip(nodes, gradients, counts, strict=True), 3):
            self.move(k, *m)

    def learn(self, ids: np.ndarray, last: bool = False) -> None:
        """Whole steps over what is held and ids; the rest is held, so that steps do not depend on how texts come in batches."""
        if len(self.held):
            ids = np.concatenate([self.held[:-SIDE], ids if len(ids) else self.held[-SIDE:]])
        at = SIDE
        while at < len(ids) - SIDE:
            end = at + min(MOST, LEAST << min(self.steps // DOUBLED, 9))
            if end > len(ids) - SIDE and not last:
                break
            end = min(end, len(ids) - SIDE)
            self.step(ids[at - SIDE : end + SIDE])
            self.steps, at = self.steps + 1, end
        self.held = ids[at - SIDE :]


def copied(net: Network) -> Network:
    new = object.__new__(Network)
    new.size, new.embedding, new.place, new.hidden, new.levels = net.size, net.embedding.copy(), net.place.copy(), net.hidden.copy(), [w.copy() for w in net.levels]
    return new


def dealt(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """The texts that have any, as `text`, with a `part` and in an order that depend on the texts alone; the number of parts. Copies are counted before the
    shuffle and numbered after it, so a text that fills a third of the rows fills no part."""
    counted = docs.filter(F.octet_length(text) > 0).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n"))
    counted = base.stored(counted.withColumn("hash", F.xxhash64("text")), "texts")
    whole = counted.agg(F.sum(F.octet_length("text") * F.col("n"))).first()[0] or 0
    parts = max(1, -(-whole // PART))
    each = counted.select("text", "hash", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    each = each.withColumn("part", F.pmod(F.xxhash64("hash", "copy"), F.lit(parts)))
    return each.repartitionByRange(parts, "part").sortWithinPartitions("part", "hash", "text", "copy"), parts


def moves(texts: DataFrame, net: Network, vocabulary: str = VOCABULARY) -> DataFrame:
    """part, block, data: of each part, what its texts moved, times the counts of the rows; then the counts. A task may hold several parts."""

    def handed(part: int, own: Descent):
        own.learn(own.held[:0], last=True)
        if own.steps:
            moved = [(w - was).reshape(len(w), -1) * n[:, None] for w, was, n in zip(own.net.weights(), net.weights(), own.counts, strict=True)]
            flat = np.concatenate([x.ravel() for x in (*moved, *own.counts)])
            for at in range(0, len(flat), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([at // BLOCK], pa.int32()), pa.array([flat[at : at + BLOCK].astype(np.float64).tobytes()], pa.binary())], names=["part", "block", "data"])

    def run(batches):
        p, part, own = pieces(vocabulary), None, None
        for batch in base.slices(batches):
            parts = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if own is None or parts[a] != part:
                    if own is not None:
                        yield from handed(part, own)
                    part, own = int(parts[a]), Descent(copied(net), p.leaf)
                own.learn(p.encode(batch.column("text").slice(a, b - a))[0])
        if own is not None:
            yield from handed(part, own)

    return base.map_arrow(texts.select("text", "part"), run, MOVES, keep=True)


def added(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of at most ADDED parts of a block, added in the order of the parts: sums of floats depend on it."""
    rows = rows.sort_values("part")
    total = np.zeros(len(rows["data"].iloc[0]) // 8)
    for data in rows["data"]:
        total += np.frombuffer(data)
    return pd.DataFrame({"part": [rows["part"].iloc[0] // ADDED], "block": [rows["block"].iloc[0]], "data": [total.tobytes()]})


def improved(docs: DataFrame, net: Network, text: str = "text", vocabulary: str = VOCABULARY) -> Network:
    """The network after one round over docs."""
    with base.scratch() as made:
        texts, parts = dealt(docs, text)
        sums = moves(texts, net, vocabulary)
        while True:
            sums = map_groups(sums.groupBy("block", F.floor(F.col("part") / ADDED)), added, MOVES, docs.sparkSession)
            parts = -(-parts // ADDED)
            if parts == 1:
                break
        sums = sums.collect()
    base.discard(*made)
    out = copied(net)
    if sums:
        flat = np.concatenate([np.frombuffer(r["data"], np.float64) for r in sorted(sums, key=lambda r: r.block)])
        ws, at = out.weights(), 0
        counts = np.split(flat[sum(w.size for w in ws) :], np.cumsum([len(w) for w in ws])[:-1])
        for w, n in zip(ws, counts, strict=True):
            w += (flat[at : at + w.size].reshape(len(w), -1) / np.maximum(n, 1)[:, None]).reshape(w.shape).astype(np.float32)
            at += w.size
    return out


def fit(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> Network:
    net = Network(pieces(vocabulary).size)
    return improved(docs, improved(docs.filter(F.pmod(F.xxhash64(text), F.lit(FIRST)) == 0), net, text, vocabulary), text, vocabulary)


def coded(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with each text's pieces, as the bytes of 16-bit numbers, in place of the text; none for null."""

    def run(batches):
        p = pieces(vocabulary)
        for batch in base.slices(batches, text):
            flat, n = p.flat(batch.column(text))
            ends = pa.array(np.concatenate([[0], np.cumsum(2 * n)])).cast(pa.int32())  # raises beyond 2 GB
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([data if name == text else batch.column(name) for name in batch.schema.names], names=batch.schema.names)

    return base.map_arrow(docs, run, T.StructType([T.StructField(text, T.BinaryType()) if f.name == text else f for f in docs.schema.fields]), keep=True)


def scored(docs: DataFrame, net: Network, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens (pieces), log_likelihood (the sum) and mean_log_likelihood."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]

    def run(batches):
        p = pieces(vocabulary)
        for batch in base.slices(batches, text):
            ids, starts, n = p.encode(batch.column(text))
            sums = np.concatenate([[0], np.cumsum(net.score(ids, p.leaf))])
            total = np.where(n > 0, sums[starts + n] - sums[starts], 0.0)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(n, pa.int64()), pa.array(total), mean], names=[*(f.name for f in kept), *(f.name for f in new)])

    return base.map_arrow(docs, run, T.StructType([*kept, *new]), keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.stored(coded(base.table(spark, sf_dir, "documents").select("doc_id", "text")), "pieces")
    return scored(docs, fit(docs)).drop("text")
