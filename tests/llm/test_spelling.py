"""Spelling variants against a plain version that compares all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from trackloom.llm import spelling


def words_by_force(rows, least=7, deleted=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def grouped_by_force(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(near), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def variants():
    r = random.Random(3)
    stock = ["".join(r.choice("abcé") for _ in range(r.choice((7, 7, 8, 9, 12)))) for _ in range(30)]
    out = []
    for d in range(60):
        line = []
        for _ in range(60):
            w = r.choice(stock[:3]) if r.random() < 0.6 else r.choice(stock)
            for _ in range(r.choice((0, 0, 0, 0, 1, 2))):
                k = r.randrange(len(w))
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abXÉ×") + w[k:], w[:k] + r.choice("abÿ") + w[k + 1 :]))
            line.append(w.upper() if r.random() < 0.1 else w)
        out.append((d, r.choice((" ", "-", "7 ")).join(line)))
    return out


@pytest.mark.parametrize(("shard", "most"), [(50_000, 16 << 20), (7, 16 << 20), (7, 2000), (1, 1)])
def test_against_force(spark, variants, monkeypatch, shard, most):
    monkeypatch.setattr(spelling, "SHARD", shard)
    words = words_by_force(variants)
    if shard == 1:
        words = dict(sorted(words.items())[:40])
    expected = grouped_by_force(words)
    assert shard == 1 or len(words) > 150
    assert shard == 1 or sum(x[0] is not None for x in expected.values()) > 40
    table = spark.createDataFrame(list(words.items()), "word string, n long") if shard == 1 else spelling.vocabulary(spark.createDataFrame(variants, "doc_id long, text string"))
    assert rows_of(spelling.grouped(table, most=most)) == expected


def test_trie_against_force():
    r = random.Random(11)
    for _ in range(60):
        words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(0, 8))) for _ in range(r.randrange(1, 40))})
        trie = spelling.Trie.unpacked(spelling.Trie(words, [1] * len(words)).packed())
        for w in {*words, *("".join(r.choice("abc") for _ in range(r.randrange(0, 9))) for _ in range(20))}:
            found = [trie.words[k] for k in trie.near(w)]
            assert len(found) == len(set(found))
            assert set(found) == {x for x in words if x != w and one_edit(w, x)}


def test_chains_of_forms(spark):
    table = spark.createDataFrame([("aaaaaaa", 100_000), ("aaaaaab", 10_000), ("aaaaabb", 1000), ("aaaabbb", 100), ("aaabbbb", 10), ("zzzzzzz", 5)], "word string, n long")
    got = rows_of(spelling.grouped(table))
    assert {w: x[1] for w, x in got.items()} == {"zzzzzzz": "zzzzzzz", **{w: "aaaaaaa" for w in got if w[0] == "a"}}
    assert got["aaabbbb"] == ("aaaabbb", "aaaaaaa", 10, 1, 100)


def test_ties_take_the_smallest(spark):
    table = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaaé", 50), ("aaaaaab", 50), ("aaaaaa", 50)], "word string, n long")
    assert rows_of(spelling.grouped(table))["aaaaaaa"] == ("aaaaaa", "aaaaaa", 2, 3, 50)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(spelling.grouped(spelling.vocabulary(odd))) == grouped_by_force(words_by_force(rows))
    assert spelling.grouped(spelling.vocabulary(none)).collect() == []


def test_very_long_words(spark):
    long = "x" * 100_000
    rows = [(d, " ".join((long, long + "y", long[:50_000] + "z" + long[50_000:]))) for d in range(30)]
    expected = grouped_by_force(words_by_force(rows))
    assert rows_of(spelling.grouped(spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")))) == expected


def test_query(spark, sf, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = words_by_force(rows)
    got = rows_of(spelling.query(spark, sf))
    assert {w: x[2] for w, x in got.items()} == words
    keys = sorted(words)
    sample = {w: words[w] for w in keys}
    by_gap = {}
    for w in sample:
        for k in range(len(w)):
            by_gap.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    for w in sample:
        near = set().union(*(by_gap[k, w[:k] + w[k + 1 :]] for k in range(len(w)))) - {w}
        near |= {w[:k] + w[k + 1 :] for k in range(len(w))} & set(words)
        near |= {x for k in range(len(w) + 1) for x in by_gap.get((k, w), ())}
        assert got[w][3] == len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        assert got[w][0] == (best if best is not None and words[best] >= 10 * words[w] else None)
