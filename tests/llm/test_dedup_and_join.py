import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import base, decontaminate, line_dedup, ngram_join


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def lines_by_force(rows, bound=line_dedup.BOUND):
    """Removed line numbers of each (doc_id, text)."""
    seen, out = [], {}
    order = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, t in order:
        out[d, t] = []
        for k, x in enumerate(t.split("\n")):
            if not x.strip(" \t\n\v\f\r"):
                continue
            if any(x == y or abs(len(x) - len(y)) <= bound and edit(x, y) <= bound for y in seen):
                out[d, t].append(k)
            seen.append(x)
    return out


@pytest.mark.parametrize(("bound", "sizes"), [(1, (15, 16, 17, 30, 31, 64, 90)), (1, (1, 2, 3, 5, 8, 13)), (2, (1, 2, 3, 5, 9, 14, 23)), (3, (1, 4, 9, 12))])
def test_near_lines_against_force(spark, monkeypatch, bound, sizes):
    r = random.Random(5 + bound)
    stock = ["".join(r.choice("abé ") for _ in range(n)) for n in sizes for _ in range(2)]

    def change(x):
        if not x:
            return "é"
        k, how = r.randrange(len(x)), r.randrange(4)
        return [x, x[:k] + x[k + 1 :], x[:k] + r.choice("zyx") + x[k:], x[:k] + r.choice("qpo") + x[k + 1 :]][how]

    def line():
        x = r.choice(stock)
        for _ in range(r.choice([0, 0, 1, 1, 2, bound + 1])):
            x = change(x)
        return x if r.random() < 0.9 else "  "

    rows = [(d, "\n".join(line() for _ in range(5))) for d in range(40)]
    monkeypatch.setattr(line_dedup, "CHUNK", 100)
    for common, send in ((1_000_000, base.BROADCAST_BYTES), (3, 100)):
        monkeypatch.setattr(line_dedup, "COMMON", common)
        monkeypatch.setattr(base, "BROADCAST_BYTES", send)
        if send == 100 and bound == 3:
            continue
        got = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True, bound=bound).collect()}
        expected = lines_by_force(rows, bound)
        assert sum(map(len, expected.values())) > 50
        for d, t in rows:
            gone = set(expected[d, t])
            assert got[d].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
            assert got[d].n_removed == len(gone)


def test_part_keys_lose_no_pair():
    """Lines within the bound share a key, whatever their lengths."""
    r = random.Random(8)
    for bound in (1, 2, 3):
        for _ in range(60):
            x = y = "".join(r.choice("ab") for _ in range(r.randrange(1, 40)))
            for _ in range(bound):
                k = r.randrange(len(y) + 1)
                y = r.choice([y[:k] + y[k + 1 :], y[:k] + "c" + y[k:], y[:k] + "d" + y[k + 1 :]]) or "c"
            own = line_dedup.Running(pa.array([x, y], pa.large_string()))
            for keys in [line_dedup.part_keys(own, bound)] + ([line_dedup.fine_keys(own)] if bound == 1 else []):
                assert set(keys[0].as_py()) & set(keys[1].as_py())


def test_lines_of_odd_rows(spark, odd, none):
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[10] == ["a line that repeats itself\n\nlast one here"]
    assert by[9] == ["", ""] and by[None][0].startswith("the quick")  # a null doc_id comes first
    assert line_dedup.dedup(odd, drop_emptied=True).filter("doc_id = 9").count() == 0
    assert line_dedup.dedup(none).count() == 0


def test_lines_query_against_sql(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got, expected = line_dedup.query(spark, sf).toPandas(), con.sql(line_dedup.ORACLE_SQL).df()
    both = got.merge(expected, on="doc_id")
    assert len(got) == len(expected) == len(both) and (both.text_x == both.text_y).all() and (both.n_removed_x == both.n_removed_y).all() and (both.n_lines_x == both.n_lines_y).all()


def classes_by_force(rows, gram, num, den=100):
    sets = [set(x.tolist()) for x in ngram_join.sets_of(pa.array([t for _, t in rows], pa.string()), gram)]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return [(d, len(sets[k]), least.get(top(k))) for k, (d, _) in enumerate(rows)]


def near_copies(seed):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    bases = [[r.choice(words) for _ in range(n)] for n in (5, 12, 30, 60, 120)]
    passage = [r.choice(words) for _ in range(25)]
    rows = []
    for d in range(110):
        t = list(r.choice(bases)) if r.random() < 0.8 else passage + [r.choice(words) for _ in range(20)]
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((d * 3 % 110, " ".join(t)))
    return rows


@pytest.mark.parametrize(("gram", "num", "hot"), [(3, 90, 16), (5, 80, 16), (2, 60, 2), (1, 50, 1000)])
def test_classes_against_force(spark, monkeypatch, gram, num, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = near_copies(gram)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), gram, num).collect())
    assert got == sorted(classes_by_force(rows, gram, num))
    assert len({c for _, _, c in got}) < len(rows)


def test_classes_of_odd_rows(spark, odd, none):
    got = sorted(map(tuple, ngram_join.classes(odd, 3, 90).collect()), key=str)
    expected = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), 7: (1, 7), 8: (1, 8), 9: (14, 9), None: (14, 9)}
    assert len(got) == odd.count()
    for d, n, c in got:
        assert (n, c) == expected.get(d, (n, c))
    assert ngram_join.classes(none).count() == 0


def test_rows_without_id_are_linked(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(7, words), (None, words + " more"), (None, "quite another text without any partner at all"), (8, words + " more things")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {(7, 58): 7, (None, 59): 7, (8, 60): 7, (None, 6): None}


def test_stage_keeps_one_of_each(spark, odd, none, sf):
    out = ngram_join.stage(spark, odd, sf)
    assert out.columns == odd.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], key=str)  # the row without an id is a copy of 9
    assert ngram_join.stage(spark, none, sf).count() == 0


def test_stage_tells_rows_of_one_id_apart(spark, sf):
    words = " ".join(f"w{k}" for k in range(60))
    other = "quite another text without any partner at all but with enough words"
    rows = [(3, words, "a"), (3, other, "b"), (3, words + " more", "c"), (1, words, "d"), (None, other + " x y z", "e"), (None, "no id and no copy anywhere else", "f"), (None, "no id and no copy anywhere else", "g"), (4, "", "h"), (4, "", "h"), (4, None, "h")]
    out = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, _by string"), sf).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, words), (3, other), (None, other + " x y z"), (None, "no id and no copy anywhere else"), (4, ""), (4, ""), (4, None)], key=str)
    assert {r._by for r in out} <= set("abcdefgh")


def test_trie_against_sets():
    rng = np.random.default_rng(1)
    bound = ngram_join.Bound(80, 100)
    for _ in range(50):
        centre = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        partners = [np.unique(np.where(rng.random(len(centre)) < 0.1, rng.integers(0, 60, len(centre)), centre).astype(np.uint64)) for _ in range(12)]
        got = sorted(ngram_join.trie_links(centre, partners, bound))
        assert got == [k for k, p in enumerate(partners) if bound.linked(len(np.intersect1d(centre, p)), len(centre), len(p))]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 50 != 49] + [(500, 400), (400, 500)], "a long, b long")
    got = {r.node: r.component for r in base.components(edges).collect()}
    assert got == {k: k // 50 * 50 for k in range(200)} | {400: 400, 500: 400}


def tiles_by_force(a, b, least):
    used_a, used_b, out = [False] * len(a), [False] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            used_a[i + k] = used_b[j + k] = True
        out += n


def test_tiling_against_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 5, n).astype(np.uint64) for n in (40, 25))
        got = decontaminate.tiles(a, b, least=3)
        assert sum(n for *_, n in got) == tiles_by_force(a.tolist(), b.tolist(), 3)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)


def test_tiling_of_repetition_is_linear():
    import time

    one = np.ones(20_000, np.uint64)
    began = time.perf_counter()
    got = decontaminate.tiles(one, one[:600])
    assert sum(n for *_, n in got) == 600 and time.perf_counter() - began < 20


def test_search_against_force(monkeypatch):
    """All pairs of text and item tiled, against the search by seeds, whatever is looked at together."""
    r = random.Random(3)
    items = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(3, 30))) for _ in range(30)] + ["a " * 40]
    texts = []
    for _ in range(60):
        w = " ".join(r.choice(items).split()[: r.randrange(1, 40)] + [r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(20))])
        texts.append(w + " " + r.choice(items))
    texts += ["", "a " * 300]
    words = lambda xs: decontaminate.plain_words(pa.array(xs, pa.string()))
    block = decontaminate.Items(list(range(len(items))), *words(items))
    expected = set()
    for t, x in enumerate(texts):
        for k, y in enumerate(items):
            a, b = words([x])[0], words([y])[0]
            covered = tiles_by_force(a.tolist(), b.tolist(), decontaminate.LEAST) if len(a) < 120 else len(b) * (y[:2] == "a ")
            if len(b) >= decontaminate.LEAST and covered >= decontaminate.THRESHOLD * len(b):
                expected.add((t, k, covered, len(b)))
    for seeds in (2_000_000, 1):
        monkeypatch.setattr(decontaminate, "SEEDS", seeds)
        assert set(block.search(*words(texts))) == expected
    assert len(expected) > 60


def test_reordered_passages_are_caught(spark, odd, none, sf):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    docs = [(1, "x y z " + " ".join(w[10:]) + " filler " + " ".join(w[:10])), (2, " ".join(w[:4]) + " . " + " ".join(w[10:14])), (3, item.upper() + "!"), (4, None), (5, ""), (6, " ".join(reversed(w))), (7, "a " * 50_000 + item)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, "beta gamma")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.items) for r in decontaminate.judge(d, bench).collect()}
    assert {k for k, (c, _) in got.items() if c} == {1, 3, 7} and got[1][1] == [1] and got[2] == (False, [])
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [2, 4, 5, 6]
    assert decontaminate.judge(odd, bench).count() == odd.join(odd.select("doc_id").distinct(), "doc_id").count() + 1
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.judge(none, bench).count() == 0
    assert decontaminate.judge(d, bench.filter("false")).filter("contaminated").count() == 0


def test_blocks_of_items_give_the_same(spark, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    assert len(list(decontaminate.blocks(bench))) > 1
    assert sorted(map(str, decontaminate.leaks(docs, bench).collect())) == whole
