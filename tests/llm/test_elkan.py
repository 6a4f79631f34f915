"""Clusters against plain rounds in Python numbers; bounds against all distances; SQL; odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import elkan

SF = "/root/testdata/sf0.001"


def plain(rows, count, rounds, seed):
    """(vec_id, cluster, distance) and the centroids, by comparing all with all."""
    x = [(i, [int(np.floor(float(v) * 64)) for v in vec]) for i, vec in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)
    centroids = [v for _, v in order[:count]]
    for step in range(rounds + 1):
        out = []
        for i, v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        if step < rounds:
            for k in range(len(centroids)):
                mine = [v for (_, v), (_, c, _) in zip(x, out) if c == k]
                if mine:
                    centroids[k] = [sum(col) // len(mine) for col in zip(*mine)]
    return out, centroids


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 9), st.sampled_from([1, 3, 40, 1 << 25]))
def test_bounds_never_change_an_assignment(seed, k, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (60, 3))
    x[30:40] = x[:10]
    centroids = x[rng.integers(0, 60, k)]  # repeated ones tie
    b, before = elkan.unknown(60, k), None
    for _ in range(5):
        b = elkan.assigned(x, centroids, b if before is None else elkan.moved(b, before, centroids))
        d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (b.cluster == d.argmin(axis=1)).all()
        assert (b.upper >= np.sqrt(d[np.arange(60), b.cluster])).all() and (b.lower.astype(float) <= np.sqrt(d)).all()
        before, centroids = centroids, centroids + rng.integers(-1, 2, centroids.shape)


def test_bounds_skip_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 6, (200, 8)) + 1000 * i for i in range(8)])
    b = elkan.assigned(x, x[::200].copy(), elkan.unknown(len(x), 8))
    again = elkan.assigned(x, x[::200].copy(), b)
    assert b.skipped > len(x) and again.skipped - b.skipped >= 8 * len(x) - len(x)


def test_query_is_plain_rounds_and_its_sql(spark):
    df = elkan.op13_elkan_clusters(spark, SF)
    got = sorted(tuple(r) for r in df.collect())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centroids = plain(rows, 16, 3, 1)
    total = sum(d for *_, d in want)
    per = [sum(d for _, c, d in want if c == k) for k in range(16)]
    assert got == sorted((i, c, d, per[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in want)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    found = con.execute(elkan.OP13_SQL)
    columns = [c[0] for c in found.description]
    assert columns == df.columns and sorted(found.fetchall()) == got


def test_odd_rows(spark):
    nan, schema = float("nan"), "vec_id long, embedding array<float>, cluster string, x string"
    rows = [(1, [0.0, 0.5]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (None, [5.0, -5.0]), (6, [-0.001, 0.5]), (6, [-0.001, 0.5]), (7, []), (8, [float("inf"), 0.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], schema)
    got = sorted(elkan.clustered(df, 2, 3, 1, 2).select("vec_id", "cluster", "distance").collect(), key=str)
    want, _ = plain([r for r in rows if r[1] and len(r[1]) == 2 and None not in r[1] and np.isfinite(r[1]).all()], 2, 3, 1)
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert elkan.clustered(df, 16, 3, 1, 2).count() == 4
    assert elkan.clustered(df.limit(0)).count() == 0 and elkan.clustered(df, dimensions=4).count() == 0
    with pytest.raises(Exception, match="below"):
        elkan.clustered(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimensions=2)
