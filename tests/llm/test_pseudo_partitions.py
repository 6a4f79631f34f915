"""Scores of the pseudo-likelihood: the same however rows are dealt, every token trained on, and each word's share of its class."""

import collections
import zlib

import numpy as np
import pytest

from brindle.llm import pseudo_likelihood as pl
from tests.llm.test_llm import SF, odd


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(pl, "GROUP_TOKENS", 20_000)  # several groups
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for n in (3, 7):
        dealt = docs.repartition(n)
        words = pl.Words.of(dealt)
        found.append({r.doc_id: r.per_token for r in pl.score(dealt, words, pl.train(dealt, words)).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == docs.count()
    assert all(found[0][k] == pytest.approx(found[1][k], abs=1e-6) for k in found[0] if found[0][k] is not None)


def test_every_token_is_masked_once():
    for n in (0, 1, 17, 5000):
        times = sum(pl.chosen(12345 - n, n, r, pl.MASKED).astype(int) for r in range(pl.ROUNDS))
        assert (times == 1).all()


def test_scores_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    words, network = pl.Words.of(docs), pl.Network.fresh()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    counts = collections.Counter(w for _, t in texts for w in t)
    rest = pl.VOCABULARY - len(words.frequent)
    sizes = np.ones(rest)
    for w, n in counts.items():
        if w not in words.frequent:
            sizes[zlib.crc32(w) % rest] += n + 1
    place = {w: i for i, w in enumerate(words.frequent)}
    want = collections.Counter()
    for i, t in texts:
        of = np.array([place.get(w, len(place) + zlib.crc32(w) % rest) for w in t], np.int64)
        share = sum(np.log((counts[w] + 1) / sizes[zlib.crc32(w) % rest]) for w in t if w not in place)
        want[(i, len(t), round(float(network.log_probabilities([of])[0].sum(dtype=np.float64) + share), 1))] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, round(r.log_probability, 1)) for r in pl.score(docs, words, network).collect())
    assert sum((want - got).values()) <= 3  # sums that round to the other side
