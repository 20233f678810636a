import math
import os

import numpy as np
import pytest

from trackloom.llm import piece_network as pn
from trackloom.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def net(docs):
    return pn.fit(docs)


def by_force(net, p, text):
    """Pieces one by one, the hidden layer and the three softmaxes written out."""
    ids = [i for w in (text or "").encode().split() for i in p.processor.encode(w.decode())]
    padded, total = [p.edge] * pn.SIDE + ids + [p.edge] * pn.SIDE, 0.0
    for k in range(len(ids)):
        h = net.hidden[0].astype(float)
        for s, place in zip(pn.SHIFTS, net.place, strict=True):
            h = h + place * net.embedding[padded[k + pn.SIDE + s]].astype(float)
        h, leaf = np.append(np.tanh(h), 1.0), int(p.leaf[ids[k]])
        for shift, w in zip(pn.LEVELS, net.levels, strict=True):
            z = h @ w[leaf >> (shift + 5)]
            total += z[(leaf >> shift) % pn.FAN] - math.log(np.exp(z).sum())
    return len(ids), total


def test_scores_against_force(net, odd, none, docs):
    p = pn.pieces(pn.VOCABULARY)
    for frame in (odd.filter("doc_id is null or doc_id not in (7, 8)"), docs.limit(12)):
        for r in pn.scored(frame, net).select("text", "n_tokens", "log_likelihood", "mean_log_likelihood").collect():
            n, total = by_force(net, p, r.text)
            assert r.n_tokens == n and r.log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-3) and (r.mean_log_likelihood is None) == (n == 0)
    assert pn.scored(none, net).count() == 0 and pn.scored(odd, net).count() == odd.count()
    assert set(odd.columns) < set(pn.scored(odd, net).columns)


def test_probabilities_of_all_pieces_add_up(net):
    p, around = pn.pieces(pn.VOCABULARY), [300, 11, 4000, 0, 7, 31000, 52]
    every = np.tile(around, (p.size, 1)).astype(np.int16)
    every[:, pn.SIDE] = np.arange(p.size)
    scores = [net.score(row, p.leaf)[pn.SIDE] for row in every[::40]]
    whole = net.inner(np.array(around, np.int16))[1]
    own = np.append(np.repeat(whole, p.size, axis=0), np.ones((p.size, 1), np.float32), axis=1)
    total = sum(np.log(q[np.arange(p.size), branch] / s) for _, _, branch, q, s in net.paths(own, np.arange(p.size)))
    assert np.exp(total.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(scores, total[p.leaf[np.arange(p.size)[::40]]], atol=1e-4)


def test_every_word_and_the_whole_window_count(spark, net, docs):
    """Words with a common ending scored alike before, and what stood two words away counted for nothing."""
    words = "the people of this country have seen that their work is good".split()

    def score(at, word):
        text = " ".join([*words[:at], word, *words[at + 1 :]])
        return pn.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first().log_likelihood

    assert len({round(score(5, w), 3) for w in ("station", "zqxvtion", "xjqwkption", "nation")}) == 4
    p = pn.pieces(pn.VOCABULARY)
    ids = np.array([p.edge] * 3 + [50, 60, 70, 80, 90, 100, 110] + [p.edge] * 3, np.int16)
    for k in range(3, 10):
        if k != 6:
            other = ids.copy()
            other[k] = 5000
            assert net.score(other, p.leaf)[6] != net.score(ids, p.leaf)[6]


def test_training_adds_up_tasks_and_learns(spark, docs, net):
    fresh, p = pn.Network(pn.pieces(pn.VOCABULARY).size), pn.pieces(pn.VOCABULARY)
    mean = lambda n: pn.scored(docs, n).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    ids = np.concatenate([p.encode(docs.select("text").toArrow().column("text").combine_chunks())[0]])
    share = np.bincount(ids[ids != p.edge]) / (ids != p.edge).sum()
    assert mean(fresh) < -9 and mean(net) > (share[share > 0] * np.log(share[share > 0])).sum()
    one, (texts, parts) = pn.improved(docs, fresh), pn.dealt(docs)
    assert parts == 1
    own = pn.Descent(pn.copied(fresh), p.leaf)
    for batch in pn.base.slices(texts.toArrow().to_batches()):
        own.learn(p.encode(batch.column("text"))[0])
    own.learn(own.held[:0], last=True)
    assert np.allclose(one.levels[0], own.net.levels[0], atol=2e-2)
    assert mean(one) > mean(fresh)


def test_one_corpus_gives_one_model(docs, monkeypatch):
    """However the table is cut, and with several parts and several rounds of adding up."""
    monkeypatch.setattr(pn, "PART", 60_000)
    monkeypatch.setattr(pn, "ADDED", 2)
    assert pn.dealt(docs)[1] > 4
    scores = []
    for cut in (docs.coalesce(1), docs.repartition(4, "source"), docs.repartition(16)):
        scored = pn.scored(docs, pn.fit(cut)).select("doc_id", "log_likelihood").toPandas().sort_values("doc_id")
        scores.append(scored["log_likelihood"].to_numpy())
    dealt = pn.dealt  # a cluster may raise or lower the number of partitions, and cut batches elsewhere
    monkeypatch.setattr(pn, "dealt", lambda d, text="text": ((f := dealt(d, text))[0].repartition(29, "part").sortWithinPartitions("part", "hash", "text", "copy"), f[1]))
    many = pn.scored(docs, pn.fit(docs)).select("doc_id", "log_likelihood").toPandas().sort_values("doc_id")
    monkeypatch.setattr(pn, "dealt", lambda d, text="text": ((f := dealt(d, text))[0].coalesce(1).sortWithinPartitions("part", "hash", "text", "copy"), f[1]))
    few = pn.scored(docs, pn.fit(docs)).select("doc_id", "log_likelihood").toPandas().sort_values("doc_id")
    assert np.allclose(scores[0], many["log_likelihood"], rtol=1e-6) and np.allclose(scores[0], few["log_likelihood"], rtol=1e-6)
    assert np.allclose(scores[0], scores[1], rtol=1e-6) and np.allclose(scores[0], scores[2], rtol=1e-6)


def test_copies_are_dealt_apart(spark, odd, none, monkeypatch):
    monkeypatch.setattr(pn, "PART", 2_000)
    same = spark.range(2000).selectExpr("'a text that is found in many rows' text")
    texts, parts = pn.dealt(same.unionByName(odd.filter("doc_id in (1, 2, 5, 9, 10)").select("text")))
    rows = texts.selectExpr("text", "part").toPandas()
    assert len(rows) == 2004 and parts == 34 and rows.groupby("part").size().max() < 120
    fresh = pn.Network(pn.pieces(pn.VOCABULARY).size)
    assert pn.dealt(none)[0].count() == 0 and np.array_equal(pn.improved(none, fresh).embedding, fresh.embedding)


def test_no_score_is_infinite(net):
    p = pn.pieces(pn.VOCABULARY)
    far = pn.copied(net)
    for w in far.levels:
        w *= 4000
    ids = np.array([p.edge] * 3 + [50, 60, 31000, 80] + [p.edge] * 3, np.int16)
    assert np.isfinite(far.score(ids, p.leaf)).all()


def test_texts_are_encoded_once(odd, none, docs, net, monkeypatch):
    """Each round and the scoring encoded the texts again."""
    frame = odd.filter("doc_id is null or doc_id not in (7, 8)").select("doc_id", "text").union(docs.limit(12).select("doc_id", "text"))
    many, once = (pn.scored(f, net).drop("text").toPandas() for f in (frame, pn.coded(frame)))
    assert len(many) == frame.count() and pn.coded(none).count() == 0
    assert many[["doc_id", "n_tokens"]].equals(once[["doc_id", "n_tokens"]]) and np.allclose(many.iloc[:, 2:], once.iloc[:, 2:], rtol=1e-5, equal_nan=True)
    p, table = pn.pieces(pn.VOCABULARY), pn.coded(frame).toArrow().combine_chunks()
    plain = [p.encode(b.column("text")) for b in frame.toArrow().combine_chunks().to_batches()]
    monkeypatch.setattr(p, "words", None)  # pieces are not encoded again, whole or in slices
    coded = [p.encode(b.column("text")) for b in table.to_batches()]
    assert all(np.array_equal(x, y) for u, v in zip(plain, coded, strict=True) for x, y in zip(u, v, strict=True))
    assert p.encode(table.column("text").combine_chunks().slice(3, 4))[2].tolist() == coded[0][2][3:7].tolist()


def test_a_step_by_force():
    """Gradients of one step, written out in doubles."""
    p, ids = pn.pieces(pn.VOCABULARY), np.random.default_rng(3).integers(200, 900, 1400).astype(np.int16)
    ids[[0, 1, 2, 700, 701, 702, -3, -2, -1]] = p.edge
    own, fresh = pn.Descent(pn.Network(p.size), p.leaf), pn.Network(p.size)
    own.step(ids)
    middle = np.arange(pn.SIDE, len(ids) - pn.SIDE)
    middle = middle[ids[middle] != p.edge]
    near = np.stack([ids[middle + k] for k in pn.SHIFTS], 1).astype(int)
    x = fresh.embedding.astype(float)[near]
    h = np.tanh((x * fresh.place).sum(1) + fresh.hidden)
    full, leaf, back = np.append(h, np.ones((len(h), 1)), 1), p.leaf[ids[middle]].astype(int), 0
    want = [np.zeros(w.shape) for w in fresh.weights()]
    for k, (shift, w) in enumerate(zip(pn.LEVELS, fresh.levels, strict=True), 3):
        node = leaf >> (shift + 5)
        q = np.exp(np.einsum("nd,ndf->nf", full, w[node].astype(float)))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(q)), (leaf >> shift) % pn.FAN] -= 1
        np.add.at(want[k], node, full[:, :, None] * q[:, None, :])
        back = back + np.einsum("nf,ndf->nd", q, w[node, : pn.WIDTH].astype(float))
    back = back * (1 - h * h)
    np.add.at(want[0], near, back[:, None, :] * fresh.place)
    want[1], want[2] = (back[:, None, :] * x).sum(0), back.sum(0, keepdims=True)
    for k, (w, was, g) in enumerate(zip(own.net.weights(), fresh.weights(), want, strict=True)):
        sure = np.abs(g) > 1e-2
        assert sure.any() and np.allclose((was - w)[sure], (pn.RATE * g / np.sqrt(1e-6 + g * g))[sure], rtol=1e-2), k
        assert np.allclose(own.squares[k], 1e-6 + g * g, rtol=1e-2, atol=1e-4), k


def test_query_is_the_piece_network():
    assert queries.QUERIES["op7_lm_scoring"] is pn.query
