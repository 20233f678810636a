"""Bands of the quality rules: learnt from labels, open for prose, held against plain Python."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import quality_rules

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers") or not os.path.isdir(SF), reason="no vocabulary files or test tables")

PROSE = {
    "en": "The old ferry leaves the harbour at seven every morning, and by the time the sun has cleared the hills the first passengers are already drinking coffee on the upper deck. Nobody talks much. A woman reads the paper, two boys watch the gulls, and the captain waves to a fisherman he has known since school.",
    "de": "Die alte Fähre verlässt den Hafen jeden Morgen um sieben, und wenn die Sonne über den Hügeln steht, trinken die ersten Fahrgäste schon Kaffee auf dem Oberdeck. Niemand spricht viel. Eine Frau liest die Zeitung, zwei Jungen beobachten die Möwen, und der Kapitän winkt einem Fischer, den er seit der Schulzeit kennt.",
    "fr": "Le vieux bac quitte le port chaque matin à sept heures, et quand le soleil passe au-dessus des collines, les premiers voyageurs boivent déjà leur café sur le pont supérieur. Personne ne parle beaucoup. Une femme lit le journal, deux garçons regardent les mouettes, et le capitaine salue un pêcheur qu'il connaît depuis l'école.",
    "es": "El viejo transbordador sale del puerto cada mañana a las siete, y cuando el sol ha pasado las colinas los primeros viajeros ya toman café en la cubierta superior. Nadie habla mucho. Una mujer lee el periódico, dos muchachos miran las gaviotas, y el capitán saluda a un pescador que conoce desde la escuela.",
}


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bands = quality_rules.learnt(docs, labels, learn=lambda d: fold(d) != 0)
    return bands, quality_rules.measure(docs.join(labels, "doc_id"), bands=bands).join(labels, "doc_id").cache()


def test_bad_rows_go_and_clean_rows_stay(judged):
    """On rows of fold 0, which the bands were not learnt from."""
    bands, rows = judged
    assert {"en", "de", "fr", "es"} <= bands.keys()
    held = rows.filter("not base_failed").filter(fold(F.col("doc_id")) == 0).select("quality", "kept").collect()
    bad, clean = [r.kept for r in held if r.quality == 0], [r.kept for r in held if r.quality == 1]
    assert len(bad) > 30 and np.mean(bad) < 0.4 and len(clean) > 500 and np.mean(clean) > 0.95


def test_sound_prose_stays(spark, judged):
    """With the bands learnt from invented text, with none, and without a language."""
    for bands in (judged[0], quality_rules.BANDS):
        for lang in (True, False):
            rows = [(k, t, k if lang else None) for k, t in PROSE.items()]
            assert all(r.kept for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id string, text string, lang string"), bands=bands).collect())


def plain(rows, labels, needed, share=quality_rules.SHARE):
    """(base_failed, kept) of each row (doc_id, text, lang), by plain Python."""
    p, is_byte = quality_rules.pieces(quality_rules.VOCABULARY)

    def measures(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        ids = [i for w in words for i in p.encode(w)]
        n = Counter(ids)
        bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()) if ids else 0.0
        even = bits / math.log2(min(len(ids), quality_rules.FULL)) if len(ids) > 1 else 1.0
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        return failed, sum(map(len, words)) / max(len(ids), 1), sum(bool(is_byte[i]) for i in ids) / max(len(ids), 1), even

    clean = {d for d, q in labels if q == 1 and d is not None and zlib.crc32(str(d).encode()) % 5}
    pool = {}
    for d, t, lang in rows:
        if d in clean and lang is not None:
            pool.setdefault(lang, {}).setdefault(d, []).append(t)
    bands = dict(quality_rules.BANDS)
    for lang, ids in pool.items():
        got = [m for m in (measures(min((t for t in ts if t is not None), default=None)) for ts in ids.values()) if not m[0]]
        if len(got) >= needed:
            q = lambda k, s, got=got: float(np.percentile([m[k] for m in got], 100 * s))
            bands[lang] = (q(1, share), 9.0, max(quality_rules.SLACK, q(2, 1 - share)), q(3, share))
    out = []
    for d, t, lang in rows:
        failed, per, byte, even = measures(t)
        b = bands[lang] if lang in bands else bands[quality_rules.script(t or "")]
        out.append((d, t, failed, not failed and b[0] - 1e-9 <= per <= b[1] and byte <= b[2] + 1e-9 and even >= b[3] - 1e-9))
    return sorted(out, key=str)


def held(spark, docs, labels, needed):
    learn = lambda d: fold(d) != 0
    bands = quality_rules.learnt(docs, labels, learn=learn, needed=needed)
    found = quality_rules.measure(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text", "lang"), bands=bands).collect()
    return sorted(((r.doc_id.doc_id, r.doc_id.text, r.base_failed, r.kept) for r in found), key=str)


@pytest.mark.parametrize("needed", [5, 10_000])
def test_kept_against_plain(spark, needed):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows, marks = [(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()]
    expected = plain(rows, marks, needed)
    assert held(spark, docs, labels, needed) == expected
    assert {x[3] for x in expected} == {True, False}


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    marks = [(k, 1) for k in range(12)] + [(None, 1), (9, 1), (3, 0), (77, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    assert held(spark, odd, labels, 1) == plain(rows, marks, 1)
    assert quality_rules.judged(none, labels).count() == 0 and quality_rules.judged(odd, labels.limit(0)).count() == len(rows)
    assert quality_rules.judged(odd.drop("lang"), labels).count() == len(rows)


def test_bands_are_those_of_all_rows(spark):
    """More clean rows than the sample of before held; the bands are the quantiles of all of them."""
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("word"), F.sha2(F.concat_ws("-", "id", F.lit(k)), 256).substr(1, 4)) for k in range(12))).alias("text"), F.lit("xx").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    rows = quality_rules.measured(docs).filter("not base_failed").collect()
    assert len(rows) > 5000
    q = lambda c, s: float(np.percentile([r[c] for r in rows], 100 * s))
    expected = (q("chars_per_token", 0.01), 9.0, max(quality_rules.SLACK, q("byte_share", 0.99)), q("entropy_share", 0.01))
    assert quality_rules.learnt(docs, labels)["xx"] == pytest.approx(expected, abs=1e-12)
