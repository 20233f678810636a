"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi. At each
position the automaton's output links give all pieces that end there; they relax the best score of that position.

A slice of texts is encoded at once: the automaton runs over all its distinct stretches, and each step of the Viterbi pass
relaxes one position of every stretch. Long stretches take the same steps one by one.

Scores are those of the vocabulary. A code point without a piece of its own costs the least score less UNKNOWN and is told by
byte pieces. A space becomes the mark U+2581, and one is put before the text; a U+2581 of the
text itself goes by byte pieces, so decoding gives back every text exactly.

No piece holds a line feed, or a space after anything but spaces (checked on loading), so no piece crosses the cuts before
runs of spaces and around line feeds: the stretches between are encoded by themselves, each distinct one once per task while a bounded memory holds it.

Defined results: a null text has null ids, an empty text none; ties go to the longest last piece at each position; repeated
rows are encoded alike; an empty table gives an empty one. Extra columns pass through
`encode`; an input column with the name of an output is replaced. Texts are encoded whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import base

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
MARK = "▁"
#: Distinct stretches a task remembers at once, and the longest remembered, in bytes.
REMEMBERED, SHORT = 150_000, 64
#: Code points of a stretch up to which it is encoded beside others, and code points encoded at once.
LONG, TOGETHER = 200, 400_000
#: Most entries of the automaton's table (states with pieces beyond them, times symbols); without a table stretches are encoded one by one.
TABLE = 1 << 26
#: Bytes of text looked at at once.
SLICE = 1_000_000
#: Stand for a U+2581 of the text and for the end of a stretch; surrogates occur in no text and no piece.
_OWN_MARK, _END = "\ud800", "\ud801"
_loaded: dict = {}


class Automaton:
    """The Aho-Corasick automaton of some pieces as a table of next states by state and symbol, for many texts at once.

    A state that no piece goes beyond has the `row` of the state its failure link leads to. Symbols are the code points of pieces of two or more; any other code point leads back to the start, and a piece of it
    alone is looked up. `longest` is the longest piece that ends in a state, `shorter` the output link from piece to piece.
    """

    def __init__(self, pieces: list[tuple[str, int]], many: int):
        symbols = sorted({c for p, _ in pieces if len(p) > 1 for c in p})
        self.symbol = np.full(0x110000, len(symbols), np.int32 if len(symbols) > 0xFFFF else np.uint16)
        self.alone = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in symbols]] = np.arange(len(symbols))
        for p, i in pieces:
            if len(p) == 1:
                self.alone[ord(p)] = i
        inner = [(p, i) for p, i in pieces if len(p) > 1 or self.symbol[ord(p)] < len(symbols)]
        states = sorted({p[:k] for p, _ in inner for k in range(len(p) + 1)}, key=lambda x: (len(x), x)) or [""]
        number = {x: k for k, x in enumerate(states)}
        piece = np.full(len(states), -1, np.int32)
        piece[[number[p] for p, _ in inner]] = [i for _, i in inner]
        self.shorter = np.full(many, -1, np.int32)
        depth = np.fromiter(map(len, states), np.int64, len(states))
        parent = np.array([number[x[:-1]] for x in states], np.int64)
        by = np.array([self.symbol[ord(x[-1])] if x else 0 for x in states], np.int64)
        inner = np.zeros(len(states), bool)
        inner[parent] = True
        self.row = np.where(inner, np.cumsum(inner) - 1, 0)
        rows = int(inner.sum())
        small = np.uint16 if len(states) <= 0x10000 else np.int32
        self.table = np.zeros((rows, len(symbols) + 1), small) if rows * (len(symbols) + 1) <= TABLE else None
        if self.table is None:
            return
        fail = np.zeros(len(states), np.int64)
        self.longest = piece.copy()
        for d in range(int(depth.max()) + 1):
            here, below = np.flatnonzero(depth == d), np.flatnonzero(depth == d + 1)
            if d > 1:
                fail[here] = self.table[self.row[fail[parent[here]]], by[here]]
            if d:
                leaf = here[~inner[here]]
                self.row[leaf] = self.row[fail[leaf]]
                grown = here[inner[here]]
                self.table[self.row[grown]] = self.table[self.row[fail[grown]]]
                ends = self.longest[fail[here]]
                own = piece[here] >= 0
                self.shorter[piece[here][own]] = ends[own]
                self.longest[here] = np.where(own, piece[here], ends)
            self.table[self.row[parent[below]], by[below]] = below


class Codec:
    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        """pieces: (piece, score) by id, '' for control pieces; byte_ids: the id of each byte's piece."""
        import ahocorasick

        self.automaton, self.byte_ids, special = ahocorasick.Automaton(ahocorasick.STORE_INTS), byte_ids, set(byte_ids)
        real = [(p, s, i) for i, (p, s) in enumerate(pieces) if p and i not in special]
        self.size, self.score = np.zeros(len(pieces), np.int64), np.zeros(len(pieces))
        for piece, score, i in real:
            self.automaton.add_word(piece, i)
            self.size[i], self.score[i] = len(piece), score
        self.automaton.make_automaton()
        self.many_at_once = Automaton([(p, i) for p, _, i in real], len(pieces))
        self.unknown = min(s for _, s, _ in real) - UNKNOWN
        #: Whether stretches may be encoded by themselves; if not, a text is one stretch.
        self.cut = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in real)
        self.bytes = [p.replace(MARK, " ").encode() for p, _ in pieces]
        for value, i in enumerate(byte_ids):
            self.bytes[i] = bytes([value])
        self.spelled = pa.array(self.bytes, pa.large_binary())
        self.memory: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in _loaded:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            many = p.get_piece_size()
            plain = ["" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else p.id_to_piece(i) for i in range(many)]
            _loaded[path] = cls([(x, p.get_score(i)) for i, x in enumerate(plain)], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        return _loaded[path]

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best pieces of a text in which spaces are marked; a negative number stands for a code point told by its bytes."""
        best, back = [0.0], []
        sizes, scores = self.size, self.score
        found = self.automaton.iter(text)
        end, i = next(found, (-1, 0))
        for at in range(len(text)):
            top, step, alone = -np.inf, None, False
            while end == at:
                size = int(sizes[i])
                alone = alone or size == 1
                score = scores[i] + best[at + 1 - size]
                if score > top:
                    top, step = score, (size, i)
                end, i = next(found, (-1, 0))
            if not alone and best[at] + self.unknown > top:
                top, step = best[at] + self.unknown, (1, -1 - ord(text[at]))
            best.append(top)
            back.append(step)
        out, at = [], len(text)
        while at:
            size, i = back[at - 1]
            out.append(i)
            at -= size
        return out[::-1]

    def viterbi_together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`viterbi` of many texts at once, one position of all of them in a step: the ids, one text after the other, and
        the number of ids of each."""
        links = self.many_at_once
        points = np.frombuffer(_END.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.int32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        place = np.arange(len(points)) - np.repeat(starts, size + 1)
        symbol, alone = links.symbol[points], links.alone[points]
        outside = symbol == links.table.shape[1] - 1
        # The slot after a text's last code point is that of the sign after it, so `best` needs no slots of its own.
        best, back, chosen = np.full(len(points), -np.inf), np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        best[starts] = 0.0
        order = np.argsort(-size, kind="stable")
        row, count = starts[order], np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)) + 1), side="left")
        state = np.zeros(len(row), np.int64)
        for t in range(int(size.max(initial=0))):
            at = row[: count[t]] + t
            state = links.table[links.row[state[: len(at)]], symbol[at]]
            piece = np.where(outside[at], alone[at], links.longest[state])
            top, step, pick = np.full(len(at), -np.inf), np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
            on = np.flatnonzero(piece >= 0)
            ending = piece[on]
            while len(on):
                length = self.size[ending]
                new = best[at[on] + 1 - length] + self.score[ending]
                better = new > top[on]
                won = on[better]
                top[won], step[won], pick[won] = new[better], length[better], ending[better]
                ending = links.shorter[ending]
                more = ending >= 0
                on, ending = on[more], ending[more]
            # A code point without a piece of its own is told by bytes: the last choice at its place.
            bare = np.flatnonzero(alone[at] < 0)
            new = best[at[bare]] + self.unknown
            better = new > top[bare]
            won = bare[better]
            top[won], step[won], pick[won] = new[better], 1, -1 - points[at[won]]
            best[at + 1], back[at + 1], chosen[at + 1] = top, step, pick
        # Backwards over all texts at once; each piece is noted where it begins.
        out, begins, at = np.zeros(len(points), np.int64), np.zeros(len(points), bool), (starts + size)[size > 0]
        while len(at):
            to = at - back[at]
            out[to], begins[to] = chosen[at], True
            at = to[place[to] > 0]
        many = np.concatenate([[0], np.cumsum(begins)])
        return out[begins], many[starts + size] - many[starts]

    def _told(self, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with each negative one replaced by the byte pieces of its code point."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32), many
        values, which = np.unique(ids[odd], return_inverse=True)
        signs = [MARK if -1 - v == ord(_OWN_MARK) else chr(-1 - v) for v in values.tolist()]
        told = [[self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")] for x in signs]
        width = np.ones(len(ids), np.int64)
        width[odd] = np.array([len(x) for x in told])[which]
        to = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width).astype(np.int32)
        flat, first = np.array(list(chain.from_iterable(told)), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in told])])[:-1]
        n = width[odd]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[odd], n) + inner] = flat[np.repeat(first[which], n) + inner]
        ends = np.concatenate([[0], np.cumsum(many)])
        return out, to[ends[1:]] - to[ends[:-1]]

    def encode_stretches(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of each stretch, as the bytes of 32-bit numbers."""
        texts = [x.decode().replace(MARK, _OWN_MARK).replace(" ", MARK) for x in stretches]
        out: list[bytes] = [b""] * len(texts)
        together: list[int] = []
        held = 0

        def spend():
            nonlocal held
            ids, many = self._told(*self.viterbi_together([texts[k] for k in together]))
            raw, ends = ids.tobytes(), np.cumsum(many * 4).tolist()
            for k, a, b in zip(together, [0, *ends], ends):
                out[k] = raw[a:b]
            together.clear()
            held = 0

        for k, x in enumerate(texts):
            if len(x) > LONG or self.many_at_once.table is None:
                ids = np.array(self.viterbi(x), np.int64)
                out[k] = self._told(ids, np.array([len(ids)]))[0].tobytes()
                continue
            together.append(k)
            held += len(x) + 1
            if held > TOGETHER:
                spend()
        if together:
            spend()
        return out

    def stretches(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts, a space put before each that is not empty, and where each text's begin."""
        texts = texts.cast(pa.large_string())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        new = np.zeros(len(data) + 1, bool)
        if self.cut:
            line, space = data == 10, data == 32
            new[:-1] = line
            new[1:] |= line
            new[1:-1] |= space[1:] & ~space[:-1]
        new[offsets] = True
        new[-1] = True
        cuts = np.flatnonzero(new)
        before = np.concatenate([[0], np.cumsum(new)])
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        return lists, before[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        stretches, starts = self.stretches(pc.fill_null(texts, ""))
        encoded = stretches.dictionary_encode()
        codes, names = np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.to_pylist()
        memory = self.memory
        if len(memory) + len(names) > REMEMBERED:
            memory.clear()
        own = [memory.get(x) for x in names]
        new = [k for k, x in enumerate(own) if x is None]
        for k, ids in zip(new, self.encode_stretches([names[k] for k in new]), strict=True):
            own[k] = ids
            if len(names[k]) <= SHORT:
                memory[names[k]] = ids
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, first = np.frombuffer(b"".join(own), np.int32), np.concatenate([[0], np.cumsum(size)])[:-1]
        each = size[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])] if len(codes) else flat
        return ids, ends[starts]

    def decode(self, ids) -> str:
        own = self.bytes
        return b"".join([own[i] for i in ids]).decode("utf-8", "replace")[1:]

    def decoded(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The bytes of each text, the space before it left out."""
        told = self.spelled.take(pa.array(ids.astype(np.int32)))
        ends = np.frombuffer(told.buffers()[1], np.int64)[told.offset : told.offset + len(told) + 1][starts]
        full = np.diff(ends) > 0
        data = np.delete(np.frombuffer(told.buffers()[2] or b"", np.uint8)[: ends[-1]], ends[:-1][full])
        ends = ends - np.concatenate([[0], np.cumsum(full)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", check: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the ids of each whole text; `check` names a column that says whether they decode to the text."""
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(check, T.BooleanType())] if check else [])
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]

    def run(batches):
        codec = Codec.load(vocabulary)
        for batch in base.slices(batches, text, SLICE):
            texts = batch.column(text)
            flat, starts = codec.encode(texts)
            column = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat), mask=texts.is_null())
            same = [pc.equal(codec.decoded(flat, starts), texts.cast(pa.large_binary()))] if check else []
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), column, *same], names=[*(f.name for f in kept), *(f.name for f in new)])
        codec.memory.clear()

    return base.map_arrow(docs, run, T.StructType([*kept, *new]))


def decode(coded: DataFrame, ids: str = "token_ids", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """coded with the text of the ids."""
    kept = [f for f in coded.schema.fields if f.name != text]

    def run(batches):
        codec = Codec.load(vocabulary)
        for batch in batches:
            texts = pa.array([None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), texts], names=[*(f.name for f in kept), text])

    return base.map_arrow(coded, run, T.StructType([*kept, T.StructField(text, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(base.table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip")
    return out.selectExpr("doc_id", "cast(size(token_ids) as bigint) n_tokens", "token_ids", "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document with its token ids, and whether they decode to its text."""
    return encode(docs, check="round_trip")
