"""Features and fit of the ranking against plain forms."""

import collections
import zlib

import numpy as np
import pytest

from brindle.llm import quality_ranking as q
from tests.llm.test_llm import SF


def brute_shares(text):
    words = text.split()
    crc = [zlib.crc32(w.lower()) for w in words]
    out = []
    for n, keys in ((q.WORDS, crc), (q.PAIRS, [31 * a + b for a, b in zip(crc, crc[1:], strict=False)]), (q.TRIPLES, [961 * a + 31 * b + c for a, b, c in zip(text, text[1:], text[2:], strict=False)])):
        counts = collections.Counter(k % n for k in keys)
        out += [(counts[b] / max(len(keys), 1)) ** 0.5 for b in range(n)]
    return out


def test_shares_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(q, "CHUNK", 50)
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + [b"", b" \n", b"a", b"a b", "é".encode() * 60]
    rows = q.Features()(texts)
    for text, row in zip(texts, rows, strict=True):
        assert row[len(q.SURFACE) :] == pytest.approx(brute_shares(text) if text.split() else [0.0] * (q.N_FEATURES - len(q.SURFACE)))
        assert (row >= 0).all() and (row <= 1).all()
    words = [b"Ab", b"cd!", b"cd!", b"|", b"9"]
    assert q.surface(b" ".join(words), words) == pytest.approx([np.log(6) / 12, 10 / 5 / 20, 1 / 5, 2 / 5, 1 / 5, 1 / 6, 1 / 10, 4 / 5, 1 / 5, 0, 0, 0])


def test_pairs_against_brute_force():
    rng = np.random.default_rng(0)
    good, bad, w = rng.normal(size=(37, 4)), rng.normal(size=(23, 4)) - 0.5, rng.normal(size=4)
    x = (good[:, None] - bad[None]).reshape(-1, 4)
    p = 1 / (1 + np.exp(x @ w))
    gradient, curvature = q._all_pairs(good, bad, w, block=10)
    assert gradient == pytest.approx(x.T @ p / len(x)) and curvature == pytest.approx((x * (p * (1 - p))[:, None]).T @ x / len(x))


def test_the_threshold_against_brute_force():
    rng = np.random.default_rng(3)
    good = rng.random(900) < 0.7
    rows = rng.normal(size=(900, 3)) + good[:, None] * 0.6
    ranking = q.fit(rows, good)
    raw = np.sort(rows @ np.array(ranking.weights))
    k = int((~good).sum())
    assert ranking.threshold == pytest.approx((raw[k - 1] + raw[k]) / 2) and (ranking.scores(rows) < 0.5).sum() == k


def test_repeated_ids_use_one_of_their_rows(spark):
    texts = [(i, "clean words of a text " * 20 if i % 2 else "!!! $$$ | " * 30) for i in range(60)]
    docs = spark.createDataFrame(texts + [(3, "zz " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    of = q.Features()
    rows = {r.doc_id: r.x for r in q._featured(docs.where("doc_id = 3"), "text").collect()}
    assert any(np.allclose(rows[3], of([t.encode()])[0]) for t in (texts[3][1], "zz " * 100))
    one, two = q.learn(docs, labels), q.learn(docs.repartition(5), labels.repartition(3))
    assert one.weights == two.weights and (one.threshold, one.spread) == pytest.approx((two.threshold, two.spread))
