"""The five stages of the pipeline, and the classifier's query, against plain Python, row by row, on small tables."""

import os
import random
import re

import pytest
import regex
import zstandard

from trackloom.llm import base, decontaminate, quality_classifier, sentencepiece_codec

from .test_dedup_and_join import lines_by_force, tiles_by_force

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files")

GOOD = "river morning village garden window harbour letter evening journey kitchen bridge winter summer orchard valley market station teacher doctor sailor candle lantern pepper blanket feather mountain meadow shadow silver copper".split()
BAD = "zzq xkcd7 qqwx vbnm9 ffgh asdf1 lkjh poiu8 mnbv wert5 hjkl3 yuio trew6 qaz wsx2 edc rfv4 tgb yhn ujm0".split()


def by_hand(text: str, good: bytes, bad: bytes) -> float:
    """The compressed-size difference of a text, each block by a compressor of its own."""
    raw, total = text.encode(), 0
    for at in range(0, len(raw), 512):
        block = raw[at : at + 512]
        sizes = [len(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress(block)) for d in (good, bad)]
        total += sizes[1] - sizes[0]
    return total / max(1, len(raw))


def straight(x: float, at, share) -> float:
    if x <= at[0]:
        return share[0]
    for (a, p), (b, q) in zip(zip(at, share, strict=True), list(zip(at, share, strict=True))[1:], strict=False):
        if x <= b:
            return p + (q - p) * (x - a) / (b - a) if b > a else q
    return share[-1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark of a corpus made by seed, with what each stage is there for."""
    r = random.Random(17)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    for k in range(60):
        rows.append((k, "\n".join(say(GOOD, r.randrange(6, 14)) for _ in range(r.randrange(2, 5)))))
        labels.append((k, 1))
    for k in range(60, 90):
        rows.append((k, say(BAD, 30)))
        labels.append((k, 0))
    items = [(k, say(GOOD, 14)) for k in range(4)] + [(9, None), (10, "")]
    footer, base_text = say(GOOD, 9), say(GOOD, 60)
    rows += [(100 + k, say(GOOD, 25) + "\n" + (footer if k % 2 else footer[:-1] + "x")) for k in range(6)]  # a line repeated, exactly and within an edit
    rows += [(110, footer)]  # nothing is left of it
    rows += [(120 + k, " ".join(base_text.split()[:57] + [say(GOOD, 1) for _ in range(k)])) for k in range(4)]  # near duplicates
    rows += [(130 + k, say(GOOD, 12) + " " + items[k][1] + " " + say(GOOD, 12)) for k in range(3)]  # leaks
    half = items[3][1].split()
    rows += [(140, say(GOOD, 8) + " " + " ".join(half[7:]) + " " + say(GOOD, 8) + " " + " ".join(half[:7]))]  # a leak in another order
    rows += [(150, None), (151, ""), (152, " \n "), (None, say(GOOD, 30)), (153, rows[5][1]), (154, say(GOOD, 20)), (154, say(GOOD, 20))]
    rows += [rows[-1], (0, rows[0][1])]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*x, "en", "s", len(x[1] or ""), "own") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, _score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def model_of(spark, d):
    return quality_classifier.fit(base.table(spark, d, "documents"), base.table(spark, d, "labels"), learn=lambda doc_id: quality_classifier.fold(doc_id) != 0)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(text)]


def stages_by_hand(rows, items, model):
    """(doc_id, text) after each of the first four stages."""
    out = [[x for x in rows if straight(by_hand(x[1] or "", model.good, model.bad), model.at, model.share) >= quality_classifier.THRESHOLD]]
    gone, left = lines_by_force(out[-1]), []
    for d, t in out[-1]:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if k not in gone.get((d, t), ())]
        if t is None or not gone[d, t]:
            left.append((d, t))
        elif any(words(x) for x in kept):
            left.append((d, "\n".join(kept)))
    out.append(left)
    sets = []
    for _, t in left:
        w = lowered(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    kept = []
    for k, x in enumerate(left):
        if not sets[k]:
            kept.append(x)
            continue
        best = min((m for m in range(len(left)) if group[m] == group[k]), key=lambda m: (left[m][0] is None, left[m][0] or 0))
        ties = [m for m in range(len(left)) if group[m] == group[k] and left[m][0] == left[best][0]]
        assert len({left[m] for m in ties}) == 1  # else a hash decides, which this version does not know
        if k == best:
            kept.append(x)
    out.append(kept)
    plain = lambda t: [p for p in (regex.sub(decontaminate._PUNCTUATION, "", w.lower()) for w in words(t)) if p]
    clean = []
    for d, t in kept:
        a = plain(t)
        leaked = any(len(b) >= decontaminate.LEAST and tiles_by_force(a, b, decontaminate.LEAST) >= decontaminate.THRESHOLD * len(b) for b in (plain(x) for _, x in items))
        if not leaked:
            clean.append((d, t))
    out.append(clean)
    return out


def sortable(rows):
    return sorted(rows, key=str)


def test_stages_against_plain(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d, rows, items = tables
    expected = stages_by_hand(rows, items, model_of(spark, d))
    docs, sizes = base.table(spark, d, "documents"), [len(rows)]
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        docs = base.stored(stage(spark, docs, d), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_score"], name
        assert sortable((r.doc_id, r.text) for r in docs.collect()) == sortable(wanted), name
        sizes.append(len(wanted))
    assert sizes[1] <= sizes[0] - 25 and sizes[2] < sizes[1] and sizes[3] < sizes[2] - 2 and sizes[4] <= sizes[3] - 4  # each stage does something
    clean = {k for k in range(60)} - {5}
    assert clean <= {k for k, _ in expected[-1]}  # and leaves clean rows alone
    final = corpus_pipeline.run(spark, d).collect()
    assert sortable((r.doc_id, r.text) for r in final) == sortable(expected[-1])
    codec = sentencepiece_codec.Codec.load(sentencepiece_codec.VOCABULARY)
    for r in final:
        assert (r.token_ids is None) == (r.text is None)
        if r.text:
            assert r.round_trip and codec.decode(r.token_ids) == r.text and r._score == "own"


def test_classifier_query_against_plain(spark, tables):
    d, rows, _ = tables
    model = model_of(spark, d)
    import zlib

    got = sortable((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in quality_classifier.query(spark, d).collect())
    scores = [(k, straight(by_hand(t or "", model.good, model.bad), model.at, model.share)) for k, t in rows]
    assert got == sortable((k, k is not None and zlib.crc32(str(k).encode()) % 5 == 0, round(s, 9), int(s >= 0.3)) for k, s in scores)
    assert {p for *_, p in got} == {0, 1}


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tables, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d, _, _ = tables
    for name, docs in (("odd", odd.drop("_row", "_score")), ("none", none)):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        for t in ("labels", "benchmark"):
            base.table(spark, d, t).write.parquet(f"{at}/{t}.parquet")
        out = corpus_pipeline.run(spark, at)
        assert set(docs.columns) <= set(out.columns)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert (ids == []) if name == "none" else 3 < len(ids) < docs.count()
