import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import quality_classifier, quality_rules, sentencepiece_codec, token_counts

needs_vocabularies = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files")


@needs_vocabularies
def test_histogram_and_sums(spark, odd, none):
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    lengths = [len(encode(r.text or "")) for r in odd.select("text").collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(odd))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == dict(Counter(lengths))
    for limit, r in rows.items():
        assert r.docs_fitting == sum(n <= limit for n in lengths) and r.docs_longer == sum(n > limit for n in lengths)
        assert r.tokens_total == sum(lengths) and r.tokens_truncated == sum(min(n, limit) for n in lengths)
    for limit in (0, 1, 7, 50, 10**6):
        assert token_counts.truncated(sums, limit).first()[0] == sum(min(n, limit) for n in lengths)
    got = {r.share: r.n_tokens for r in token_counts.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect()}
    assert got == {s: sorted(lengths)[math.ceil(s * len(lengths)) - 1] for s in got}
    assert token_counts.suffix_sums(token_counts.histogram(none)).count() == 0


def test_classifier_on_held_out_rows(spark, docs, sf):
    big = "/root/testdata/sf0.01"
    if not os.path.isdir(big):
        pytest.skip("no test tables")
    got = quality_classifier.query(spark, big).toPandas()
    assert got["score"].between(0, 1).all() and (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_classifier_of_odd_rows(spark, odd, none, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.scored(odd, model, output="score")
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == odd.count() and out.filter("score between 0 and 1").count() == odd.count()
    assert quality_classifier.stage(spark, odd, sf).columns == odd.columns
    assert quality_classifier.scored(none, model).count() == 0
    bare = quality_classifier.fit(docs, labels.filter("quality = 1"))
    assert quality_classifier.scored(odd, bare).filter("score < 0.99").count() == 0
    assert quality_classifier.fit(none, labels.filter("false")).probability(np.zeros(1))[0] == pytest.approx(0.5)


def rules_by_force(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), n < 10 or 100 * len(again) > 20 * n


@needs_vocabularies
def test_rules_against_force(spark, odd, none, docs):
    for frame in (odd, docs):
        texts = {(r.doc_id, k): r.text for k, r in enumerate(frame.select("doc_id", "text").collect())}
        got = quality_rules.measure(frame).collect()
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(str((d, *rules_by_force(t))) for (d, _), t in texts.items())
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.measure(none).count() == 0


@needs_vocabularies
def test_fertility_against_force(spark, docs):
    p, is_byte = quality_rules.pieces(quality_rules.VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for r in quality_rules.measure(docs.filter(docs.doc_id.isin(list(texts)))).collect():
        ids = [i for w in texts[r.doc_id].encode().split() for i in p.encode(w.decode())]
        counts = Counter(ids)
        assert r.n_tokens == len(ids) and r.byte_share == pytest.approx(sum(bool(is_byte[i]) for i in ids) / max(1, len(ids)))
        assert r.token_entropy == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()))


def test_scripts():
    assert [quality_rules.script(x) for x in ("hello", "привет", "日本語です", "123 !", "مرحبا", "γειά")] == ["Latin", "Cyrillic", "Han", "Other", "Arabic", "Greek"]


@needs_vocabularies
def test_codec_round_trip(spark, odd, none):
    out = sentencepiece_codec.encode(odd, check="round_trip")
    rows = out.select("doc_id", "text", "token_ids", "round_trip").collect()
    assert all(r.round_trip or r.text is None for r in rows) and [r.token_ids for r in rows if r.text == ""] == [[]] and [r.token_ids for r in rows if r.text is None] == [None]
    back = sentencepiece_codec.decode(out.withColumnRenamed("text", "was")).collect()
    assert all(r.text == r.was for r in back)
    assert sentencepiece_codec.encode(none).count() == 0 and set(odd.columns) < set(out.columns)


def test_viterbi_against_all_splits():
    rng = np.random.default_rng(4)
    letters = "abc▁"
    pieces = sorted({"".join(rng.choice(list(letters), n)) for n in (1, 2, 2, 3, 3, 3, 4) for _ in range(3)} | {"a"})
    scores = rng.normal(-5, 2, len(pieces)).round(3)
    byte_ids = list(range(len(pieces), len(pieces) + 256))
    codec = sentencepiece_codec.Codec([(p, float(s)) for p, s in zip(pieces, scores, strict=True)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)], byte_ids)
    known = dict(zip(pieces, scores, strict=True))

    def best(text):
        if not text:
            return 0.0
        found = [known[text[:n]] + best(text[n:]) for n in range(1, min(4, len(text)) + 1) if text[:n] in known]
        if text[0] not in known:
            found.append(codec.unknown + best(text[1:]))
        return max(found)

    for _ in range(80):
        text = "".join(rng.choice(list("abcd▁"), rng.integers(1, 9)))
        ids = codec.viterbi(text)
        assert sum(known[pieces[i]] if i >= 0 else codec.unknown for i in ids) == pytest.approx(best(text))
        assert "".join(pieces[i] if i >= 0 else chr(-1 - i) for i in ids) == text


def test_many_texts_against_one_pass_over_each_whole_text(monkeypatch):
    """Cut into stretches, encoded side by side, against the plain Viterbi pass over the text as one stretch."""
    rng = np.random.default_rng(11)
    letters = list("abcé▁")
    pieces = sorted({"▁" * rng.integers(0, 2) + "".join(rng.choice(letters[:4], n)) for n in (1, 2, 2, 3, 3, 4, 4, 5) for _ in range(6)} | {"a", "b", "▁", "▁▁", "語"})
    scores = (rng.normal(-5, 2, len(pieces)) * 4).round() / 4  # sums are exact, so ties are
    many = len(pieces)
    codec = sentencepiece_codec.Codec([(p, float(s)) for p, s in zip(pieces, scores, strict=True)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)], list(range(many, many + 256)))
    assert codec.cut and codec.many_at_once.table is not None
    signs = ["a", "b", "c", "é", " ", "  ", "\n", "▁", "語", "x", "🎉", "\t", "\x00"]
    texts = [None, "", " ", "\n", "a" * 700, "▁"] + ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(200)]

    def whole(text):
        out = []
        for i in codec.viterbi((" " + text).replace("▁", sentencepiece_codec._OWN_MARK).replace(" ", "▁")) if text else []:
            sign = "▁" if i == -1 - ord(sentencepiece_codec._OWN_MARK) else None
            out += [i] if i >= 0 else [many + b for b in (sign or chr(-1 - i)).encode()]
        return out

    for long, together, table in ((200, 400_000, 1 << 26), (3, 50, 1 << 26), (200, 400_000, 10)):
        monkeypatch.setattr(sentencepiece_codec, "LONG", long)
        monkeypatch.setattr(sentencepiece_codec, "TOGETHER", together)
        if table == 10:
            codec.many_at_once.table = None
        codec.memory.clear()
        ids, starts = codec.encode(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
        assert got == [whole(x) for x in texts]
        assert [x.decode() for x in codec.decoded(ids, starts).to_pylist()] == [x or "" for x in texts]
        assert [codec.decode(x) if x else "" for x in got] == [x or "" for x in texts]


@needs_vocabularies
def test_codec_stage_of_odd_rows(spark, odd, none, sf):
    out = sentencepiece_codec.stage(spark, odd, sf)
    assert out.count() == odd.count() and out.filter("not round_trip").count() == 0 and set(odd.columns) < set(out.columns)
    assert sentencepiece_codec.stage(spark, none, sf).count() == 0


def test_slices_hold_every_row():
    from trackloom.llm import base

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 100, 3, 2, 50)] + [None]})
    parts = list(base.slices([batch], most=10))
    assert sum(p.num_rows for p in parts) == 7 and [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_pipeline(spark, sf, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r.round_trip for r in rows) and set(docs.columns) < set(out.columns)
    assert len({r.doc_id for r in rows}) == len(rows)
