"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of a given share or more, and the
classes they fall into.

Sets are stored in a global order: shingles that many sets share come last, the others by hash. Two similar sets share a
shingle of their prefixes (the first n - least overlap + 1 of each), which deals out what may meet. What meets is joined by
prefix tree: the partners of a set, sorted in the global order, form a trie in which equal beginnings are one path; it is
walked once for all partners, overlaps of a shared beginning are counted once, and a subtree is cut off when the overlap so
far and the lengths that remain cannot reach the bound.

Groups. Equal sets fold into one before anything meets. Shingles of a hot passage go to the end of the order, so documents that
share nothing else do not meet. In a group of near copies every set first meets one centre for each shingle of its prefix; linked sets
become one class, and only sets of different classes that still share a prefix shingle meet further. So a group of copies
costs about as many pairs as it has sets, and no link between classes is lost.

Defined results: words are lower-cased from A to Z; a text of fewer words than a shingle is one shingle; without words (or
null) the set is empty, linked with nothing. Repeated rows have equal sets and so one class; a null doc_id can be linked and
counts as no smallest id, unless its class has no other (component_id null). An empty table gives an empty one. Extra columns are not read. Texts are read whole.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from . import base

#: Sets that share a shingle of their prefixes from which on the shingle goes to the end of the order. It steers costs, not results.
HOT = 16
#: Times at most that hot shingles are looked for; each time the sets get new prefixes.
REORDERED = 2
#: Shingles kept beyond a set's prefix, as a share of it and at least; so most new prefixes need no second look at the texts.
SPARE, LEAST_SPARE = 0.5, 8
#: Rounds of centres at most for groups that fall into several classes, before all that is left meets. They end when few pairs (WORTH of them) are linked.
CENTRES = 3
WORTH = 0.1
#: Ranges of the hash in which the shingles of a set are counted; the sum of the smaller counts bounds the overlap of two sets.
BINS = 64
#: Shingles of a set by which a pair that shares several is told apart from one met before; more would only save repeated pairs.
SEEN = 8
#: Most partners in one trie, and most sets of one shingle whose pairs one task looks at; larger groups meet block by block.
PARTNERS = 512
BLOCK = 4096
#: Nodes of a trie's path that are matched before its bound is looked at again.
STEP = 128
_HOT_BIT = np.uint64(1 << 63)


class Bound:
    """Similarity of num / den or more, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        """Shingles of which linked sets share one: what any partner must overlap is at least num / den of n."""
        return n - -(-self.num * n // self.den) + 1

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)


def ordered(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set in the global order, as sorted numbers: hot shingles have the highest bit."""
    if not len(hot) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return np.sort(np.where(hot[at] == tokens, tokens | _HOT_BIT, tokens))


def sets_of(texts: pa.Array, gram: int):
    """Sorted shingle sets (63-bit) of a slice of texts."""
    split = base.Words(texts, lower=True)
    hashes = split.hashes()
    grams = base.gram_hashes(hashes, gram) >> np.uint64(1)
    for a, b in zip(split.starts[:-1].tolist(), split.starts[1:].tolist(), strict=True):
        if b - a >= gram:
            yield np.unique(grams[a : b - gram + 1])
        else:
            yield base.shingle_set(hashes[a:b], gram) >> np.uint64(1)


def identity(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int((base.mix(base.mix(tokens.sum(dtype=np.uint64)) + base.mix(tokens).sum(dtype=np.uint64)) + np.uint64(len(tokens))).astype(np.int64))


SETS = "set long, n long, bins array<short>, tokens array<long>"


def sets(docs: DataFrame, gram: int, bound: Bound, hot: np.ndarray | None = None, whole: bool = False, spare: bool = False) -> DataFrame:
    """doc_id, row (a hash of the text), set, n, bins, tokens of every row: the prefix of its set (and spare shingles after it) or, with `whole`, all of it, in
    the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(hot if hot is not None else np.zeros(0, np.uint64))

    def run(batches):
        hot = sent.value
        for batch in base.slices(batches):
            names, sizes, tokens, bins = [], [], [], []
            for plain in sets_of(batch.column("text"), gram):
                n = len(plain)
                names.append(identity(plain) if n else None)
                sizes.append(n)
                count = np.bincount((plain >> np.uint64(57)).astype(np.int64), minlength=BINS)
                bins.append(count.astype(np.int16) if count.max(initial=0) < 1 << 15 else None)
                own, first = ordered(plain, hot), bound.prefix(n) if n else 0
                kept = n if whole else first + (max(LEAST_SPARE, int(SPARE * first)) if spare else 0)
                tokens.append((own if whole else own[:kept] & ~_HOT_BIT).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tokens)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bins, pa.list_(pa.int16())), lists], names=["doc_id", "row", "set", "n", "bins", "tokens"])

    return base.map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("row")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, {SETS}")


def prefixed(kept: DataFrame, bound: Bound, hot: np.ndarray) -> DataFrame:
    """set, n, bins, tokens: prefixes in the order with `hot` last, from the kept shingles (in hash order) of sets; tokens are null where too
    many of those are hot to tell."""
    sent = kept.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot = sent.value
        for batch in batches:
            n = np.asarray(batch.column("n"))
            lists = batch.column("tokens")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            flat = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(hot, flat), max(len(hot) - 1, 0))
            late = hot[at] == flat if len(hot) else np.zeros(len(flat), bool)
            out = []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                first, own, bad = bound.prefix(int(n[k])), flat[a:b], late[a:b]
                if not bad[:first].any():
                    out.append(own[:first].view(np.int64))
                elif b - a == n[k] or (b - a) - bad.sum() >= first:
                    out.append(np.concatenate([own[~bad], own[bad]])[:first].view(np.int64))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("n"), batch.column("bins"), pa.array(out, pa.list_(pa.int64()))], names=["set", "n", "bins", "tokens"])

    return base.map_arrow(kept.select("set", "n", "bins", "tokens"), run, SETS)


def trie_links(centre: np.ndarray, partners: list[np.ndarray], bound: Bound) -> list[int]:
    """Which partners are linked with the centre. Sorted, the partners are the paths of a trie from left to right; a path
    shares with the one before as many nodes as they have first shingles in common. A path is followed STEP nodes at a time,
    as far as the overlap so far and the lengths that remain allow a link; no path goes further below a node where they don't."""
    order = sorted(range(len(partners)), key=lambda k: partners[k].astype(">u8").tobytes())
    out, path = [], np.zeros(0, np.uint64)
    overlap, remain = np.zeros(1, np.int64), np.array([len(centre)])  # at each depth: shared so far, and what remains of the centre
    for k in order:
        own = partners[k]
        least = bound.overlap(len(centre), len(own))
        same = min(len(path), len(own))
        differ = np.flatnonzero(path[:same] != own[:same])
        depth = int(differ[0]) if len(differ) else same
        overlap, remain = overlap[: depth + 1], remain[: depth + 1]
        while depth < len(own) and overlap[-1] + min(remain[-1], len(own) - depth) >= least:
            nodes = own[depth : depth + STEP]
            at = np.searchsorted(centre, nodes)
            hit = centre[np.minimum(at, len(centre) - 1)] == nodes
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(hit)])
            remain = np.concatenate([remain, len(centre) - at - hit])
            depth += len(nodes)
        path = own[:depth]
        if depth == len(own) and bound.linked(int(overlap[-1]), len(centre), len(own)):
            out.append(k)
    return out


def verified(pairs: DataFrame, docs: DataFrame, sources: DataFrame, gram: int, bound: Bound, hot: np.ndarray) -> DataFrame:
    """a, b of the pairs (a, b) that are linked. Each pair brings one set to the trie of its centre a; a centre of many partners has several tries.
    The sets are made again from the texts (sources: set, doc_id), for those in the pairs alone."""
    wanted = base.stored(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sources, "set"), "wanted")
    small = base.sendable(wanted, 16)
    texts = docs.join(small.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    known = sets(texts, gram, bound, hot, whole=True).join(small.select("set"), "set", "left_semi")
    known = base.stored(known.select(F.col("set").alias("b"), "tokens"), "known")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")).filter("parts > 1")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    own = dealt.select("a", "part").distinct().select("a", F.col("a").alias("b"), "part")
    dealt = base.stored(dealt.unionByName(own), "dealt")
    rows = known.join(base.sendable(dealt, 24), "b").select("a", "part", "b", "tokens")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        centre, kept = None, []
        for a, b, tokens in zip(group["a"], group["b"], group["tokens"], strict=True):
            tokens = np.asarray(tokens, np.int64).view(np.uint64)
            if a == b:
                centre = tokens
            else:
                kept.append((b, tokens))
        found = trie_links(centre, [t for _, t in kept], bound) if centre is not None and kept else []
        return pd.DataFrame({"a": [int(group["a"].iloc[0])] * len(found), "b": [int(kept[k][0]) for k in found]}, dtype="int64")

    out = base.stored(shipping.map_groups(rows.groupBy("a", "part"), run, "a long, b long", pairs.sparkSession).distinct(), "links")
    base.discard(known, wanted, dealt)
    return out


def crossing(rows: DataFrame, bound: Bound) -> DataFrame:
    """lo, hi: pairs of sets of different labels that share a shingle and whose sizes and bins allow a link.

    rows: token, set, n, label, bins. Sets of one shingle lie side by side in a sorted partition and are compared there, so no row
    is made for a pair that the bounds rule out, nor, as far as the first SEEN shingles of both tell, for one met at a smaller
    shingle. A shingle of more than BLOCK sets is cut into blocks; each two blocks meet in a task of their own.
    """
    firsts = rows.groupBy("set").agg(F.slice(F.array_sort(F.collect_list("token")), 1, SEEN).alias("firsts"))
    rows = rows.join(base.stored(firsts, "firsts"), "set")
    sizes = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    rows = rows.join(base.sendable(base.stored(sizes, "blocks"), 16), "token", "left").withColumn("own", F.pmod(F.xxhash64("set"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    rows = rows.withColumn("_o", other).select("token", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "set", "n", "label", "bins", "firsts")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "set")

    def within(token, own, sets_, n, label, bins, free, firsts):
        """Pairs of one group by rows: each row with those after it."""
        out, block = [], own[0] == own[-1] and (own == own[0]).all()
        for k in range(len(sets_) - 1):
            rest = slice(k + 1, None)
            fit = (label[rest] != label[k]) & (sets_[rest] != sets_[k]) & (bound.den * np.minimum(n[rest], n[k]) >= bound.num * np.maximum(n[rest], n[k]))
            if not block:
                fit &= own[rest] != own[k]
            at = np.flatnonzero(fit) + k + 1
            if len(at):
                most = np.minimum(bins[at], bins[k]).sum(axis=1)
                at = at[(most >= bound.overlap(n[at], n[k])) | free[at] | free[k]]
            if len(at):
                before = firsts[k][firsts[k] < token]
                if len(before):
                    at = at[~np.isin(firsts[at], before).any(axis=1)]
                out.append(np.column_stack([np.full(len(at), sets_[k]), sets_[at]]))
        return out

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            yield from spent(held, False)
            held = remainder(held)
        if held is not None:
            yield from spent(held, True)

    def cuts(batch):
        keys = [np.asarray(batch.column(c)) for c in ("token", "i", "j")]
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def remainder(batch):
        at = cuts(batch)
        return batch.slice(at[-1]) if len(at) else None

    def spent(batch, all_of_it):
        at = cuts(batch)
        ends = [*at[1:], batch.num_rows] if all_of_it else at[1:]
        if not len(ends):
            return
        own, sets_, n, label = (np.asarray(batch.column(c)) for c in ("own", "set", "n", "label"))
        free = np.asarray(batch.column("bins").is_null())
        flat = np.zeros((batch.num_rows, BINS), np.int32)
        known = batch.column("bins").drop_null()
        flat[~free] = np.asarray(known.flatten()).reshape(-1, BINS)
        token, lists = np.asarray(batch.column("token")), batch.column("firsts")
        width = np.asarray(lists.value_lengths()).astype(np.int64)
        firsts = np.full((batch.num_rows, SEEN), np.iinfo(np.int64).max)
        firsts[np.repeat(np.arange(batch.num_rows), width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)] = np.asarray(lists.flatten())
        out = []
        for x, y in zip(at, ends):
            out += within(token[x], own[x:y], sets_[x:y], n[x:y], label[x:y], flat[x:y], free[x:y], firsts[x:y])
        if out:
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["lo", "hi"])

    return base.map_arrow(rows, run, "lo long, hi long").distinct()


def classes(docs: DataFrame, gram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row of docs."""
    rows = grouped(docs, gram, num, den)
    least = rows.filter("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "_class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def grouped(docs: DataFrame, gram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, row (a hash of the text), n (the size of its set), _class (alike for all that links reach; null for an empty set) of every
    row of docs."""
    bound = Bound(num, den)
    docs = docs.select("doc_id", "text")
    first = base.stored(sets(docs, gram, bound, spare=True), "sets")
    members = base.stored(first.select("doc_id", "row", "set", "n"), "members")
    single = base.stored(members.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id")), "single")
    one = base.sendable(single, 16)
    # One row of each set; rows without a doc_id count where no other row has their set.
    begun = first.join(one, ["set", "doc_id"], "left_semi").unionByName(first.filter("doc_id is null").join(one.filter("doc_id is null").select("set"), "set", "left_semi"))

    def shared(prefixes: DataFrame) -> DataFrame:
        """token, many: the prefix shingles of two sets or more. Only shingles are shuffled, counted by tasks before."""
        return base.stored(prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("many")).filter("many > 1"), "shared")

    hot = np.zeros(0, np.uint64)
    prefixes = base.stored(prefixed(begun, bound, hot), "prefixes")
    written, tokens = [prefixes], shared(prefixes)
    for _ in range(REORDERED):
        least = HOT
        while tokens.filter(F.col("many") > least).count() * 8 > base.BROADCAST_BYTES:
            least *= 2
        found = tokens.filter(F.col("many") > least).select("token").toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64)
        if not len(np.setdiff1d(found, hot)) or (len(hot) + len(found)) * 8 > 4 * base.BROADCAST_BYTES:
            break
        hot = np.union1d(hot, found)
        base.discard(*written, tokens)
        told = base.stored(prefixed(begun, bound, hot), "prefixes")
        # Sets too full of hot shingles are made again from their texts.
        full = base.stored(told.filter("tokens is null").select("set").join(single, "set"), "full")
        small = base.sendable(full, 16)
        texts = docs.join(small.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
        again = base.stored(sets(texts, gram, bound, hot).join(small.select("set"), "set", "left_semi").select("set", "n", "bins", "tokens").dropDuplicates(["set"]), "again")
        prefixes, written = told.filter("tokens is not null").unionByName(again), [told, again, full]
        tokens = shared(prefixes)
    meet = prefixes.select("set", "n", F.explode("tokens").alias("token")).join(base.sendable(tokens, 8), "token")
    meet = base.stored(meet, "meet")
    bins = prefixes.join(base.sendable(base.stored(meet.select("set").distinct(), "names"), 8), "set", "left_semi").select("set", "bins")
    bins = base.stored(bins, "bins")
    begun = prefixes = told = again = None
    base.discard(*written, tokens, first)

    links, tested, labels, last = None, None, None, False
    for turn in range(CENTRES + 2):
        last = last or turn > CENTRES
        if labels is None:
            now = meet.withColumn("label", F.col("set"))
        else:
            now = meet.join(base.sendable(labels, 16), "set", "left").withColumn("label", F.coalesce("label", "set"))
        if turn:
            # Of two sets that share a shingle, one was the centre of the first turn, so that pair is settled.
            now = now.filter("many > 2")
            mixed = base.stored(now.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token"), "mixed")
            now = now.join(base.sendable(mixed, 8), "token", "left_semi")
        if not last:
            # A centre for each shingle: another one in each turn, so that classes which their first centre missed meet.
            at = F.struct(F.xxhash64("set", F.lit(turn)).alias("h"), "set", "n", "label")
            centre = now.groupBy("token").agg(F.min(at).alias("c"))
            pairs = now.join(centre, "token").filter("c.label <> label").select(F.col("c.set").alias("u"), F.col("c.n").alias("m"), F.col("set").alias("v"), "n")
            pairs = pairs.filter((den * F.least("m", "n") >= num * F.greatest("m", "n")) & (F.col("u") != F.col("v")))
            pairs = pairs.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v"), "size": F.col("m") + F.col("n")}).groupBy("lo", "hi").agg(F.min("u").alias("a"), F.first("size").alias("size"))
            # An upper bound of the overlap from the bins: what cannot reach the least overlap goes no further.
            for side in ("lo", "hi"):
                pairs = pairs.join(bins.select(F.col("set").alias(side), F.col("bins").alias(f"{side}_bins")), side)
            most = F.aggregate(F.zip_with("lo_bins", "hi_bins", lambda p, q: F.least(p, q).cast("int")), F.lit(0), lambda p, q: p + q)
            pairs = pairs.filter(F.coalesce(most * (num + den) >= F.col("size") * num, F.lit(True))).select("lo", "hi", "a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
        else:
            pairs = crossing(now.join(bins, "set"), bound).select("lo", "hi", F.col("lo").alias("a"), F.col("hi").alias("b"))
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = base.stored(pairs, "candidates")
        many = pairs.count()
        new = 0
        if many:
            tested = pairs.select("lo", "hi") if tested is None else tested.unionByName(pairs.select("lo", "hi"))
            found = verified(pairs.select("a", "b"), docs, single, gram, bound, hot)
            new = found.count()
            links = found if links is None else links.unionByName(found)
            if new:
                old, labels = labels, base.stored(base.components(links.select("a", "b")).select(F.col("node").alias("set"), F.col("component").alias("label")), "labels")
                now = None
                base.discard(old)
        if last:
            break
        last = new < WORTH * max(many, 1)
    rows = members.join(base.sendable(labels, 16), "set", "left") if labels is not None else members.withColumn("label", F.lit(None).cast("long"))
    return rows.select("doc_id", "row", "n", F.coalesce("label", "set").alias("_class"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(base.table(spark, sf_dir, "documents"), gram=3, num=90, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near duplicates (five words, 0.8) one document stays: the one with the least doc_id (rows without one
    come last), then with the least hash of its text; of equal rows one. Documents without words stay. Texts that share only a doc_id are
    documents of their own. An empty table gives an empty one; other columns pass through, whatever their names."""
    rows = base.stored(grouped(docs).groupBy("_class", "doc_id", "row").agg(F.count("*").alias("rows")), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "rows")
    one = rows.filter("_class is not null").groupBy("_class").agg(F.min(order).alias("k")).select("k.doc_id", "k.row", "k.rows")
    keep = base.stored(one.unionByName(rows.filter("_class is null").select("doc_id", "row", F.lit(1).cast("long").alias("rows"))), "keep")
    by, own, at, many = (base.free(docs, x) for x in ("_by", "_own", "_at", "_many"))
    side = base.sendable(keep.select(F.col("doc_id").alias(by), F.col("row").alias(at), F.col("rows").alias(many)), 32)
    kept = docs.withColumn(own, F.xxhash64("text")).join(side, F.col("doc_id").eqNullSafe(F.col(by)) & F.col(own).eqNullSafe(F.col(at)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    equal = kept.filter(F.col(many) > 1)
    return kept.filter(F.col(many) == 1).select(*columns).unionByName(equal.dropDuplicates(["doc_id", own]).select(*columns))
