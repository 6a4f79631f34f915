"""Whitening against numpy over exact whole numbers, and odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import whitening

SF = "/root/testdata/sf0.001"


def check(rows, got, most=16):
    """got: (vec_id, component) rows, against the definition."""
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fit])
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, min(most, len(sums)) + 1))
    for k, found in by.items():
        assert set(found) == set(x)
        for i, r in found.items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[i], sums))
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-6) and r.identity_error < 1e-6
    one = {x[i]: i for i in x}
    w = np.array([[by[k][one[v]].whitened for k in sorted(by)] for v in fit])
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-6
    back = centred @ v  # a projection on a component, times its eigenvalue, is its projection after V
    for k in range(w.shape[1]):
        axis, *_ = np.linalg.lstsq(centred, w[:, k] * np.sqrt(values[k]), rcond=None)
        assert np.allclose(back @ axis, values[k] * (centred @ axis), rtol=1e-6, atol=1e-6 * values[0])


def test_query_is_the_definition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, whitening.op11_whitening(spark, SF).collect())


def test_odd_rows(spark):
    nan, rng = float("nan"), np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(20)] + [(20, [1e-3, -1e-3, 0.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 1.0]), (53, []), (54, [float("inf"), 0.0, 0.0])]
    copies = [(i + 100, v) for i, v in good[:5]]
    alone = [(200, [1.0, 2.0])]  # a length of one vector has no variance
    df = spark.createDataFrame([(*r, "own", "own") for r in good + bad + copies + alone], "vec_id long, embedding array<double>, n string, x string").repartition(3)
    got = whitening.whitened(df).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good + copies}
    check(good + copies, got)
    two = whitening.whitened(df.select("vec_id", "embedding").union(spark.createDataFrame([(None, [3.0, 2.0]), (None, [3.0, 2.0])], "vec_id long, embedding array<double>")))
    assert sorted((str(r.vec_id), round(abs(r.whitened), 6), r.n) for r in two.where("n = 2").collect()) == [("200", 1.0, 2), ("None", 1.0, 2), ("None", 1.0, 2)]
    assert whitening.whitened(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="below"):
        whitening.whitened(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).count()


def test_exact_sums_beyond_a_long():
    model = whitening.Whitening(1 << 45, np.array([(1 << 45) * 10], object), np.zeros((1, 0)), np.zeros(0))
    assert model.squares(np.array([[10], [11]])) == [0, None] and model.centred(np.array([[11]]))[0, 0] == 1.0
    small = whitening.Whitening(3, np.array([10, 20], object), np.zeros((2, 0)), np.zeros(0))
    assert small.squares(np.array([[3, 7]])) == [(9 - 10) ** 2 + (21 - 20) ** 2]
