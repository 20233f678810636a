"""Quality rules: base counts of words, symbols, repeated lines and repeated windows, then the fertility of a public
tokeniser (characters per token, share of byte-fallback tokens, entropy of the tokens) against bands per language or,
where the language has none, per script.

Bands of a language are learnt from all of the corpus' own clean labelled texts (`learnt`), by exact quantiles: the 1 % quantile of characters per token and
of entropy, and the 99 % quantile of the byte share. Text that yields more characters per token than what was learnt from is not
worse for it, so that side stays wide. A language with few labelled texts, and every script, has wide bands that hold for ordinary prose.

Defined results: a null text has no words and zero counts, so the base rule rejects it; so does one of white space. Rows are
judged one by one, so repeated rows and ties get equal results; an empty table gives an empty one, labels without a clean row leave the wide
bands. Of a doc_id with several texts the least is learnt from. Extra columns are not read, the id has any type. Texts are measured whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from . import base

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
FULL = 1024
#: Learning: the quantile, the least bound of the byte share, and clean labelled rows a language needs.
SHARE, SLACK, NEEDED = 0.01, 0.02, 50
#: Wide bands: least and most characters per token, most byte-fallback share, least entropy as a share of what so many tokens (FULL at most) allow.
BANDS = {
    "Latin": (1.30, 9.0, 0.05, 0.45),
    "Greek": (0.60, 6.0, 0.50, 0.45),
    "Cyrillic": (0.90, 7.0, 0.20, 0.45),
    "Arabic": (0.40, 6.0, 0.70, 0.40),
    "Han": (0.25, 4.0, 0.95, 0.40),
    "Other": (0.20, 9.0, 1.00, 0.40),
}
#: First code points of the ranges from which the script of most letters is read.
SCRIPTS = ((0x0, "None"), (0x41, "Latin"), (0x5B, "None"), (0x61, "Latin"), (0x7B, "None"), (0xC0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Other"), (0x600, "Arabic"), (0x780, "Other"), (0x2000, "None"), (0x2E80, "Han"), (0xA4D0, "Other"))
_loaded: dict = {}


def pieces(path: str):
    if path not in _loaded:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = p, np.array([p.is_byte(i) or p.is_unknown(i) for i in range(p.get_piece_size())])
    return _loaded[path]


def script(text: str) -> str:
    """The script of most letters; 'Other' for none."""
    if "scripts" not in _loaded:
        firsts = [k for k, _ in SCRIPTS]
        _loaded["scripts"] = np.repeat(np.arange(len(SCRIPTS), dtype=np.uint8), np.diff([*firsts, 0x110000]))
    counts = np.bincount(_loaded["scripts"][np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=len(SCRIPTS))
    total: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, counts.tolist(), strict=True):
        total[name] = total.get(name, 0) + n
    total.pop("None")
    best = max(total, key=lambda k: total[k])
    return best if total[best] else "Other"


def by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[starts])


def repeated_words(codes: np.ndarray, starts: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows of n words that occur twice or more in that text, the first time included."""
    if len(codes) < n:
        return np.zeros(len(starts) - 1, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    grams = base.gram_hashes(base.mix(codes.astype(np.uint64) + np.uint64(1)), n)
    inside = text[: len(grams)] == text[n - 1 :]
    keys = base.mix(grams + base.mix(text[: len(grams)].astype(np.uint64) + np.uint64(7)))[inside]
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(inside)[count[back] > 1]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return by_text(np.cumsum(edge[:-1]) > 0, starts)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    lists = pc.split_pattern(texts, "\n")
    coded, offsets = lists.flatten().dictionary_encode(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    codes = np.asarray(coded.indices).astype(np.int64)
    full = (np.asarray(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary))) > 0)[codes] if len(codes) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    distinct = np.unique(text[full] * (len(coded.dictionary) + 1) + codes[full])
    return by_text(full, offsets) - np.bincount(distinct // (len(coded.dictionary) + 1), minlength=len(texts))


def symbols(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    known = np.zeros(256, np.int64)
    known[list(SYMBOLS)] = 1
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return by_text(known[data], offsets - offsets[0])


def fertility(split: base.Words, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, byte-fallback tokens, entropy in bits. Each distinct word is encoded once."""
    processor, is_byte = pieces(vocabulary)
    coded = processor.encode(split.names.to_pylist(), num_threads=1) if len(split.names) else []
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.fromiter((i for x in coded for i in x), np.int64, int(size.sum()))
    first = np.concatenate([[0], np.cumsum(size)])
    each = size[split.codes] if len(coded) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(first[split.codes] - ends[:-1], each) + np.arange(ends[-1]) if len(coded) else np.zeros(0, np.int64)
    ids, starts = flat[at], ends[split.starts]
    tokens, many = np.diff(starts), len(split.starts) - 1
    text = np.repeat(np.arange(many), tokens)
    keys, n = np.unique(text * len(is_byte) + ids, return_counts=True)
    of = keys // len(is_byte)
    share = n / np.maximum(tokens, 1)[of]
    return tokens, by_text(is_byte[ids], starts), np.bincount(of, weights=-share * np.log2(share), minlength=many).astype(float)


def measured(docs: DataFrame, text: str = "text", language: str | None = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, lang, the script, the base counts and the fertility measures; no verdict."""
    lang = F.col(language).cast("string") if language and language in docs.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in base.slices(batches, "text"):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            split = base.Words(texts)
            n = split.counts
            width = np.asarray(pc.utf8_length(split.names)).astype(np.int64)
            chars = by_text(width[split.codes] if len(width) else np.zeros(0, np.int64), split.starts)
            again = repeated_words(split.codes, split.starts)
            failed = (n < 10) | (100 * again > 20 * n)
            tokens, fallback, bits = fertility(split, vocabulary)
            per, byte_share = chars / np.maximum(tokens, 1), fallback / np.maximum(tokens, 1)
            even = np.where(tokens > 1, bits / np.log2(np.clip(tokens, 2, FULL)), 1.0)
            scripts = pa.array(["Other" if bad else script(t.as_py()) for bad, t in zip(failed.tolist(), texts, strict=True)], pa.string())
            columns = [batch.column("doc_id"), batch.column("lang"), scripts, n, chars, symbols(texts), duplicate_lines(texts), again, failed, tokens, per, byte_share, bits, even]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "lang", "script", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.map_arrow(docs.select("doc_id", F.col(text).cast("string").alias("text"), lang.alias("lang")), run, f"doc_id {kind}, lang string, script string, {SCHEMA}")


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, entropy_share double"
MEASURES = [x.split()[0] for x in SCHEMA.split(", ")]


def verdict(rows: DataFrame, bands: dict = BANDS) -> DataFrame:
    """`measured` with kept: what passes the base rule and lies within the band of its language or, where that has none, of its script."""
    known = F.create_map(*(x for k, b in bands.items() for x in (F.lit(k), F.array(*(F.lit(float(v)) for v in b)))))
    name = F.when(F.col("lang").isin(*bands), F.col("lang")).otherwise(F.col("script"))
    band = F.coalesce(known[name], known[F.lit("Other")])
    within = F.col("chars_per_token").between(band[0], band[1]) & (F.col("byte_share") <= band[2]) & (F.col("entropy_share") >= band[3])
    at = MEASURES.index("base_failed") + 1
    return rows.select("doc_id", *MEASURES[:at], (~F.col("base_failed") & within).alias("kept"), *MEASURES[at:])


def measure(docs: DataFrame, text: str = "text", language: str | None = "lang", vocabulary: str = VOCABULARY, bands: dict = BANDS) -> DataFrame:
    """doc_id, the base counts, the fertility measures and the verdict."""
    return verdict(measured(docs, text, language, vocabulary), bands)


def derived(rows: DataFrame, share: float = SHARE, needed: int = NEEDED) -> dict[str, tuple[float, float, float, float]]:
    """Bands per lang from all measured rows that pass the base rule; of languages with enough rows. Quantiles are exact, by counts in buckets."""
    clean = base.stored(rows.filter(~F.col("base_failed") & F.col("lang").isNotNull()).select("lang", "chars_per_token", "byte_share", "entropy_share"), "clean")
    out = {}
    for r in clean.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= needed).collect():
        own = clean.filter(F.col("lang") == r["lang"])
        (per,), (fallback,), (even,) = (exact_quantiles(own, c, [s]) for c, s in (("chars_per_token", share), ("byte_share", 1 - share), ("entropy_share", share)))
        out[r["lang"]] = (per, max(b[1] for b in BANDS.values()), max(SLACK, fallback), even)
    return out


def learnt(docs: DataFrame, labels: DataFrame, vocabulary: str = VOCABULARY, learn=None, needed: int = NEEDED, of: DataFrame | None = None) -> dict[str, tuple[float, float, float, float]]:
    """BANDS, and those of the languages (column lang) of all clean labelled documents where the Column `learn` of the id holds (default: all).

    `of` is `measured` of all documents where that is stored. One text of each doc_id counts; where several rows share one, the least, which is measured here.
    What is collected is a row a language.
    """
    if "lang" not in docs.columns:
        return dict(BANDS)
    own = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    own = own.filter(learn(F.col("_id")) if learn else F.lit(True))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    ids = base.stored(texts.join(own, "_id", "left_semi").groupBy("_id").agg(F.min("lang").alias("lang"), F.count("*").alias("_n")), "ids")
    once = of if of is not None else measured(docs.join(ids.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi"), vocabulary=vocabulary)
    once = once.withColumnRenamed("doc_id", "_id").join(ids.filter("_n = 1").select("_id", "lang"), ["_id", "lang"], "left_semi").select("lang", *MEASURES)
    least = texts.join(ids.filter("_n > 1").select("_id", "lang"), ["_id", "lang"]).groupBy("_id", "lang").agg(F.min("text").alias("text"))
    again = measured(least.withColumnRenamed("_id", "doc_id"), vocabulary=vocabulary).select("lang", *MEASURES)
    return dict(BANDS) | derived(once.unionByName(again), needed=needed)


def judged(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """`measure` with the bands learnt from the labels. Every text is measured once; bands are learnt from, and verdicts given on, the stored measures."""
    rows = base.stored(measured(docs), "measures")
    return verdict(rows, learnt(docs, labels, learn=learn, of=rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"), lambda doc_id: F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0)
