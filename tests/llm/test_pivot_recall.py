"""Recall of the index at the least cosine as pivots grow, and vectors of many lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import pivots


@pytest.mark.parametrize("vectors", [10_000, 60_000, 400_000, 1_000_000])
def test_pairs_at_a_cosine_of_0_9(vectors):
    """Pairs at exactly 0.9 in 64 dimensions: the share that has two pivots in common."""
    most, nearest = pivots.pivots_for(vectors)
    rng = np.random.default_rng(4)
    of = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    points, x, y = of(rng.normal(size=(most, 64))), of(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    y = of(y - (y * x).sum(axis=1, keepdims=True) * x)
    p, q = pivots.described(x, points, nearest), pivots.described(0.9 * x + np.sqrt(1 - 0.81) * y, points, nearest)
    assert np.mean([len(np.intersect1d(a, b)) >= 2 for a, b in zip(p, q, strict=True)]) >= 0.95


def test_pivots_grow_with_the_root():
    assert pivots.pivots_for(0) == pivots.pivots_for(10_000) == (256, pivots.NEAREST)
    assert pivots.pivots_for(1_000_000)[0] == 2048 and pivots.pivots_for(10**12)[0] == pivots.MOST_PIVOTS


def test_rare_lengths(spark, monkeypatch):
    monkeypatch.setattr(pivots, "MOST_LENGTHS", 2)
    monkeypatch.setattr(pivots, "PIVOTS", 16)
    rows = [(100 * n + k, [1.0] * n + [0.01 * k]) for n in range(2, 9) for k in range(5)]
    got = pivots.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 4, i // 100 * 100) for i, _ in rows}
    assert pivots.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(F.col("vec_id") < 0)).count() == 0
