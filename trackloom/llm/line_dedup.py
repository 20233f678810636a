"""Line deduplication: lines that equal an earlier line of the corpus, or are within `bound` edits of one, go; the earliest stays.

Texts are split once. Equal lines fold first, by a 128-bit hash, so the rest works on distinct lines. For near lines, every line
emits all its variants within the edit bound as hashed keys: at each choice of up to `bound` places a code point is deleted or
left open. Lines with one open key are at a distance of at most the open places plus what both deleted, so the earliest line
for each number of deletions decides for the others, and a group of near copies joins as many rows as it has variants, never
all its pairs. The edit distance of each line and its earlier one is verified.

Only lines that can have a partner emit variants. Cut into bound + 1 parts, a line keeps one of them in any partner, moved by
no more than the edits beside it; for one edit, of FINE parts it keeps all but one. Lines that share no such part are left out,
which loses nothing. All hashes of parts and variants come from running (Karp-Rabin) sums, in time linear in the line.

Rules: lines are split at \\n and compared as they stand; a line of white space only is never removed. Lengths and edits count
code points; every line is compared, however short or long (the cost of a line of n is n to the power of the bound). The order
is (doc_id, place in the text), a null doc_id first. A line goes if an earlier one is equal to it or within the bound, whether
or not that one stays itself.

Defined results: a null text stays null and an empty one empty; repeated rows (equal doc_id and text) count as one and
share their fate, rows of one doc_id with other texts are ordered by a hash of the text; extra columns pass through, also
those named like columns in here. An empty table gives an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

from itertools import chain, combinations, islice, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Edits of the query and of the pipeline's stage.
BOUND = 1
#: Parts of the second choice of lines that may have a partner.
FINE = 16
#: Rows of a line from which on it is joined apart from the others, where lines are shuffled. It steers costs, not results.
COMMON = 1_000_000
#: Bytes of text whose lines are hashed at once.
SLICE = 500_000
#: Keys made at once.
CHUNK = 200_000
_BLANK = r"^[\x20\x09-\x0D]*$"
_POS = ("doc", "row", "no")
_U = np.uint64
_FACTOR, _OPEN = 0x9E3779B97F4A7C15, _U(0xD6E8FEB86659FD93)
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class Running:
    """Karp-Rabin hashes, modulo 2**64, of any stretch of some lines put one after the other."""

    def __init__(self, lines: pa.Array):
        points = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32).astype(_U)
        self.size = np.asarray(pc.utf8_length(lines)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        many = len(points)
        self.down = np.concatenate([[_U(1)], np.cumprod(np.full(many, _INVERSE, _U))]).astype(_U)
        self.up = np.concatenate([[_U(1)], np.cumprod(np.full(many, _FACTOR, _U))]).astype(_U)
        self.sums = np.concatenate([[_U(0)], np.cumsum((points + _U(1)) * self.down[:-1], dtype=_U)]).astype(_U)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from a to b (places in all lines)."""
        return (self.sums[b] - self.sums[a]) * self.up[a]


def told_apart(hashes: np.ndarray, *by) -> np.ndarray:
    """Hashes that differ where the numbers beside them do."""
    for x in by:
        hashes = base.mix(hashes + base.mix(np.atleast_1d(x).astype(_U) + _U(1)) * _U(_INVERSE))
    return hashes


def _lists(columns: list[np.ndarray], valid: list[np.ndarray]) -> pa.Array:
    """An array of lists: of each row, the values that are valid."""
    every, good = np.column_stack(columns), np.column_stack(valid)
    offsets = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(every[good].view(np.int64)))


def part_keys(own: Running, bound: int) -> pa.Array:
    """Keys of each line such that two lines within the bound have one in common: of bound + 1 parts of the shorter, one is
    in the longer, moved by no more than the edits before it and, from the end, after it."""
    n, s, keys, valid = own.size, own.start, [], []
    for less in range(bound + 1):
        m = n - less
        for j in range(bound + 1):
            a, b = m * j // (bound + 1), m * (j + 1) // (bound + 1)
            for move in range(max(-j, less - (bound - j)), min(j, less + bound - j) + 1):
                good = (m > 0) & (a + move >= 0) & (b + move <= n)
                x, y = np.where(good, s + a + move, 0), np.where(good, s + b + move, 0)
                keys.append(told_apart(own.of(x, y), m, j))
                valid.append(good)
    return _lists(keys, valid)


def fine_keys(own: Running) -> pa.Array:
    """Keys of which two lines within one edit share one: all of the line outside one of FINE parts, cut as the shorter line's."""
    n, s, keys, valid = own.size, own.start, [], []
    for less in (0, 1):
        m = n - less
        for j in range(FINE):
            a, b = m * j // FINE, m * (j + 1) // FINE + less
            good = (m > 0) & (b <= n)
            x, y, end = (np.where(good, v, 0) for v in (s + a, s + b, s + n))
            whole = (own.sums[x] - own.sums[np.where(good, s, 0)]) + (own.sums[end] - own.sums[y]) * own.up[np.where(good, b - a, 0)]
            keys.append(told_apart(whole * own.up[np.where(good, s, 0)], m, j, b - a - less))
            valid.append(good)
    return _lists(keys, valid)


def variant_keys(own: Running, k: int, bound: int):
    """Of line k, pieces of (keys, open places, deletions): all it becomes if up to `bound` places are left open or deleted."""
    s, n = int(own.start[k]), int(own.size[k])
    sums, up = own.sums, own.up
    for t in range(min(bound, n) + 1):
        chosen = combinations(range(n), t)
        while True:
            if t == 1:
                at, chosen = np.arange(n).reshape(-1, 1), iter(())
            else:
                at = np.fromiter(chain.from_iterable(islice(chosen, CHUNK)), np.int64).reshape(-1, t) if t else np.zeros((1, 0), np.int64)
            if not len(at):
                break
            for cut in product((False, True), repeat=t):
                total, last, shift = np.zeros(len(at), _U), np.full(len(at), s), 0
                for i, deleted in enumerate(cut):
                    place = s + at[:, i]
                    total += (sums[place] - sums[last]) * up[shift]
                    if not deleted:
                        total += _OPEN * own.down[place - shift]
                    shift, last = shift + deleted, place + 1
                total += (sums[s + n] - sums[last]) * up[shift]
                yield told_apart(total * up[s], np.full(len(at), n - shift), np.full(len(at), t - shift)), t - shift, shift
            if t <= 1:
                break


def told(docs: DataFrame, text: str = "text", bound: int = BOUND) -> DataFrame:
    """a, b (the hash of a line), doc, row (a hash that tells texts of one doc_id apart), no, many, keys of each line with a
    word; many and keys stand at the earliest of the equal lines that a task sees together."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(f"`{text}`").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in base.slices(batches, most=SLICE):
            batch = batch.take(pc.sort_indices(pa.Table.from_batches([batch]), sort_keys=[("doc", "ascending"), ("row", "ascending")], null_placement="at_start"))
            lists = pc.split_pattern(batch.column("text").cast(pa.large_string()), "\n")
            flat = lists.flatten()
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), size)
            no = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            full = np.asarray(pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]"))
            if not full.any():
                continue
            encoded = flat.filter(pa.array(full)).dictionary_encode()
            of, no, codes = of[full], no[full].astype(np.int32), np.asarray(encoded.indices).astype(np.int64)
            names = encoded.dictionary
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in names.cast(pa.large_binary()).to_pylist()]), np.int64).reshape(-1, 2)
            # Rows are in order, so the first row of a name is its earliest.
            first = np.unique(codes, return_index=True)[1]
            keys = np.full(len(codes), -1)
            keys[first] = np.arange(len(names))
            many = np.zeros(len(codes), np.int64)
            many[first] = np.bincount(codes, minlength=len(names))
            columns = [pa.array(hashes[codes, 0]), pa.array(hashes[codes, 1]), batch.column("doc").take(pa.array(of)), batch.column("row").take(pa.array(of)), pa.array(no)]
            columns += [pa.array(many, mask=keys < 0), part_keys(Running(names), bound).take(pa.array(keys, mask=keys < 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *_POS, "many", "keys"])

    return base.map_arrow(rows, run, f"a long, b long, doc {kind}, row long, no int, many long, keys array<long>")


def shared(keys: DataFrame) -> DataFrame:
    """key: the keys (a, key) that different lines have in common. Only keys are shuffled, folded by tasks before."""
    return base.stored(keys.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo < hi").select("key"), "shared")


def fetched(docs: DataFrame, wanted: DataFrame, text: str, bound: int) -> DataFrame:
    """a, b, doc, row, no, line, keys (fine ones, for one edit) of the wanted lines (a, b, doc, row, no)."""
    by = base.stored(wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("no", "a", "b")).alias("wanted"), F.count("*").alias("n")), "wanted")
    bytes_ = by.agg(F.sum(24 + 20 * F.col("n"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(f"`{text}`").alias("_row"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(by) if bytes_ <= base.BROADCAST_BYTES else by, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_row") == F.col("row"))).select("doc", "row", "text", "wanted")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in base.slices(batches):
            found = [(k, x["no"], x["a"], x["b"], lines[x["no"]]) for k, (t, w) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)) for lines in [t.split("\n")] for x in w]
            of, no, a, b, lines = zip(*found, strict=True)
            lines = pa.array(lines, pa.large_string())
            keys = fine_keys(Running(lines)) if bound == 1 else pa.nulls(len(lines), pa.list_(pa.int64()))
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch.column("doc").take(pa.array(of)), batch.column("row").take(pa.array(of)), pa.array(no, pa.int32()), lines.cast(pa.string()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *_POS, "line", "keys"])

    out = base.stored(base.map_arrow(rows, run, f"a long, b long, doc {kind}, row long, no int, line string, keys array<long>").dropDuplicates(["a", "b"]), "able")
    base.discard(by)
    return out


def near(able: DataFrame, bound: int) -> DataFrame:
    """a, b of the lines (a, b, doc, row, no, line) that have an earlier line within the bound."""

    def run(batches):
        for batch in base.slices(batches, "line"):
            own = Running(batch.column("line"))
            held, size = [], 0
            for k in range(batch.num_rows):
                for keys, open_, deleted in variant_keys(own, k, bound):
                    held.append((k, keys, open_, deleted))
                    size += len(keys)
                    if size >= CHUNK:
                        yield spent(batch, held)
                        held, size = [], 0
            if held:
                yield spent(batch, held)

    def spent(batch, held):
        n = [len(x[1]) for x in held]
        of = pa.array(np.repeat([x[0] for x in held], n))
        columns = [batch.column(c).take(of) for c in ("a", "b", *_POS)]
        columns += [pa.array(np.concatenate([x[1] for x in held]).view(np.int64)), pa.array(np.repeat([x[2] for x in held], n).astype(np.int32)), pa.array(np.repeat([x[3] for x in held], n).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", *_POS, "key", "open", "deleted"])

    kind = able.schema["doc"].dataType.simpleString()
    every = base.map_arrow(able.select("a", "b", *_POS, "line"), run, f"a long, b long, doc {kind}, row long, no int, key long, open int, deleted int")
    common = shared(every.select("a", "key"))
    every = base.stored(every.join(base.sendable(common, 16), "key", "left_semi").select("a", "b", F.struct(*_POS).alias("pos"), "key", "open", "deleted"), "variants")
    heads = every.groupBy("key").agg(*(F.min(F.when(F.col("deleted") == d, F.struct("pos", "a", "b"))).alias(f"h{d}") for d in range(bound + 1)))
    # Open places and the deletions of both lines add up to no more than the bound.
    may = [F.when(F.col("open") + F.col("deleted") + d <= bound, F.col(f"h{d}")) for d in range(bound + 1)]
    head = F.least(*may) if bound else may[0]
    pairs = every.join(heads, "key").select("a", "b", "pos", head.alias("h")).filter("h.pos < pos").select("a", "b", F.col("h.a").alias("c"), F.col("h.b").alias("d")).distinct()
    texts = able.select("a", "b", "line")
    pairs = pairs.join(texts, ["a", "b"]).join(texts.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("line").alias("other")), ["c", "d"])
    out = base.stored(pairs.filter(F.levenshtein("line", "other", bound).between(0, bound)).select("a", "b").distinct(), "late")
    base.discard(common, every)
    return out


def met(rows: DataFrame, side: DataFrame) -> DataFrame:
    """The rows with the columns of `side` (a, b, many, ...) for their line. Where the side is too large to send, the rows of
    very common lines meet it apart, so that no task gets all rows of one line."""
    if side.count() * 64 <= base.BROADCAST_BYTES:
        return rows.join(F.broadcast(side), ["a", "b"])
    common = base.sendable(base.stored(side.filter(F.col("many") >= COMMON), "common"), 64)
    rest = rows.join(common.select("a", "b"), ["a", "b"], "left_anti").join(side.filter(F.col("many") < COMMON), ["a", "b"])
    return rows.join(common, ["a", "b"]).unionByName(rest)


def removed(docs: DataFrame, text: str = "text", bound: int = BOUND) -> DataFrame:
    """doc, row, gone (a byte for each line, 1 where it goes), n of the texts that lose lines."""
    every = base.stored(told(docs, text, bound), "lines")
    leads = every.filter("keys is not null")
    folded = base.stored(leads.groupBy("a", "b").agg(F.min(F.struct(*_POS)).alias("first"), F.sum("many").alias("many")).filter("many > 1"), "folded")
    keys = leads.select("a", "b", *_POS, F.explode("keys").alias("key"))
    common = shared(keys.select("a", "key"))
    wanted = keys.join(base.sendable(common, 16), "key", "left_semi").groupBy("a", "b").agg(F.min(F.struct(*_POS)).alias("first")).select("a", "b", "first.*")
    able = fetched(docs, wanted, text, bound)
    base.discard(common)
    if bound == 1:
        keys = able.select("a", "b", F.explode("keys").alias("key"))
        common = shared(keys.select("a", "key"))
        kept = base.stored(keys.join(base.sendable(common, 16), "key", "left_semi").select("a", "b").distinct(), "kept")
        late = near(able.join(base.sendable(kept, 24), ["a", "b"], "left_semi"), bound)
        base.discard(common, kept)
    else:
        late = near(able, bound)
    counted = leads.join(base.sendable(late, 24), ["a", "b"]).groupBy("a", "b").agg(F.sum("many").alias("many"))
    fate = folded.withColumn("late", F.lit(False)).unionByName(counted.select("a", "b", F.lit(None).cast(folded.schema["first"].dataType).alias("first"), "many", F.lit(True).alias("late")))
    fate = base.stored(fate.groupBy("a", "b").agg(F.max("first").alias("first"), F.max("many").alias("many"), F.max("late").alias("late")), "fate")
    gone = met(every.select("a", "b", *_POS), fate).filter(F.col("late") | (F.struct(*_POS) != F.col("first"))).groupBy("doc", "row").agg(F.collect_set("no").alias("nos"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            masks = []
            for nos in batch.column("nos").to_pylist():
                mask = np.zeros(max(nos) + 1, np.uint8)
                mask[nos] = 1
                masks.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(masks, pa.binary()), pc.list_value_length(batch.column("nos")).cast(pa.int64())], names=["doc", "row", "gone", "n"])

    out = base.stored(base.map_arrow(gone, run, f"doc {kind}, row long, gone binary, n long"), "removed")
    base.discard(every, folded, able, late, fate)
    return out


def dedup(docs: DataFrame, text: str = "text", counts: bool = False, drop_emptied: bool = False, bound: int = BOUND) -> DataFrame:
    """docs with the lines that go taken out of their texts; `counts` adds n_lines and n_removed; `drop_emptied` drops rows
    all of whose lines with a word went."""
    gone = removed(docs, text, bound)
    bytes_ = gone.agg(F.sum(F.length("gone") + 64)).first()[0] or 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).withColumns({"_doc": F.col("_row.doc_id"), "_hash": F.xxhash64(F.col(f"_row.`{text}`"))})
    rows = rows.alias("r").join((F.broadcast(gone) if bytes_ <= base.BROADCAST_BYTES else gone).alias("g"), F.col("r._doc").eqNullSafe(F.col("g.doc")) & (F.col("r._hash") == F.col("g.row")), "left")
    parts = F.split(F.col(f"_row.`{text}`"), "\n", -1)
    kept = F.filter(parts, lambda x, k: F.substring("gone", k + 1, F.lit(1)) != F.lit(b"\x01"))
    left = F.when(F.col("gone").isNull(), F.col(f"_row.`{text}`")).otherwise(F.array_join(kept, "\n"))
    if drop_emptied:
        rows = rows.filter(F.col("gone").isNull() | F.exists(kept, lambda x: ~x.rlike(_BLANK)))
    out = [left.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(F.filter(parts, lambda x: ~x.rlike(_BLANK))), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(base.table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines seen before go; a document of which nothing is left goes too."""
    return dedup(docs, drop_emptied=True)


#: Two lines are within one edit if both lack the same place or one is the other less one place.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, unnest(range(len(p))) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
w AS (SELECT * FROM l WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
f AS (SELECT line, min((doc_id, no)) AS pos FROM w GROUP BY line),
g AS (SELECT line, pos, length(line) AS n, unnest(range(1, length(line) + 1)) AS k FROM f),
v AS (SELECT line, pos, n, k, hash(left(line, k - 1) || right(line, n - k)) AS cut, hash(line) AS whole FROM g),
late AS (
    SELECT line FROM (SELECT line, pos, min(pos) OVER (PARTITION BY n, k, cut) AS top FROM v) WHERE top < pos
    UNION SELECT long.line FROM v long JOIN f short ON long.cut = hash(short.line) AND long.n - 1 = length(short.line) WHERE short.pos < long.pos
    UNION SELECT short.line FROM v long JOIN f short ON long.cut = hash(short.line) AND long.n - 1 = length(short.line) WHERE long.pos < short.pos),
gone AS (SELECT doc_id, no FROM w JOIN f USING (line) WHERE (doc_id, no) <> pos OR line IN (SELECT line FROM late)),
c AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL) AS left_text, count(g.no) AS n_removed
    FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.left_text, '') END AS text,
    (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_lines, c.n_removed
FROM documents d JOIN c ON c.doc_id = d.doc_id"""
