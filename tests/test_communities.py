"""Communities in levels against a plain Louvain, label propagation, and known partitions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.operators import communities, ends, graph

EDGES = "a string, b string, weight long"


def q(edges, member):
    total = 2 * sum(w for *_, w in edges)
    inner, degree = 0, defaultdict(float)
    for a, b, w in edges:
        degree[member[a]] += w
        degree[member[b]] += w
        inner += 2 * w * (member[a] == member[b])
    return inner / total - sum(d * d for d in degree.values()) / total**2


def plain(edges):
    """One node after the other, level by level."""
    member = {n: n for e in edges for n in e[:2]}
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    total = sum(sum(v.values()) for v in near.values())
    while True:
        degree = {n: sum(v.values()) for n, v in near.items()}
        own, sums = {n: n for n in near}, dict(degree)
        moved, any_moved = True, False
        while moved:
            moved = False
            for n in sorted(near):
                sums[own[n]] -= degree[n]
                votes = defaultdict(float, {own[n]: 0.0})
                for m, w in near[n].items():
                    if m != n:
                        votes[own[m]] += w
                best = max(sorted(votes), key=lambda c: (votes[c] - degree[n] * sums[c] / total, c == own[n]))
                moved, any_moved = moved or best != own[n], any_moved or best != own[n]
                own[n] = best
                sums[best] += degree[n]
        if not any_moved:
            return member
        member = {n: own[c] for n, c in member.items()}
        up = defaultdict(lambda: defaultdict(float))
        for a, v in near.items():
            for b, w in v.items():
                up[own[a]][own[b]] += w
        near = up


def planted(seed, groups, size, inside, outside):
    r = random.Random(seed)
    names = [f"n{i:03}" for i in range(groups * size)]
    return [(a, b, r.randint(1, 4)) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if r.random() < (inside if i // size == j // size else outside)]


def ring(cliques, size):
    names = [[f"c{i:02}{j}" for j in range(size)] for i in range(cliques)]
    return [(a, b, 1) for c in names for i, a in enumerate(c) for b in c[:i]] + [(names[i][0], names[(i + 1) % cliques][1], 1) for i in range(cliques)]


@pytest.mark.parametrize("edges", [planted(2, 4, 8, 0.6, 0.1), planted(3, 1, 20, 0.25, 0.0)], ids=["planted", "random"])
def test_modularity_is_near_the_plain_one(spark, edges):
    df = spark.createDataFrame(edges, EDGES)
    found = communities.levels(df).collect()
    by = defaultdict(dict)
    for r in found:
        by[r.level][r.node] = r.community
    values = [q(edges, by[k]) for k in sorted(by)]
    assert values == sorted(values) and values[-1] >= q(edges, plain(edges)) - 0.02
    spread = {r.node: r.community for r in graph.propagated(df).collect()}
    assert values[-1] >= q(edges, spread)
    for member in by.values():
        assert all(c == min(n for n in member if member[n] == c) for c in member.values())
    told = graph.modularity(df, spark.createDataFrame(list(by[max(by)].items()), "node string, community string")).first()[0]
    assert told == pytest.approx(values[-1])


def test_a_ring_of_cliques_is_its_cliques(spark):
    found = communities.communities(spark.createDataFrame(ring(4, 4), EDGES)).collect()
    assert {(r.node[:3], r.community[:3]) for r in found} == {(f"c{i:02}", f"c{i:02}") for i in range(4)}
    rows = communities.numbered(spark.createDataFrame(found)).groupBy("number").agg(F.count("*").alias("n")).collect()
    assert {(r.number, r.n) for r in rows} == {(i, 4) for i in range(4)}


def test_odd_edges(spark):
    odd = [("a", "b", 1), ("b", "a", 2), ("c", "c", 5), (None, "a", 1), ("d", "e", 0), ("f", "g", None)]
    found = {r.node: r.community for r in communities.communities(spark.createDataFrame(odd, EDGES)).collect()}
    assert found == {"a": "a", "b": "a", "c": "c"}
    assert communities.communities(spark.createDataFrame([], EDGES)).count() == 0
    assert communities.numbered(communities.communities(spark.createDataFrame([], EDGES))).count() == 0


def test_rounds_shuffle_no_edges(spark):
    edges = spark.createDataFrame(planted(4, 3, 9, 0.7, 0.1), EDGES)
    both, names = ends.numbered_ends(edges.select("a", "b", F.col("weight").alias("w")))
    assert [r.name for r in names.orderBy("node").collect()] == sorted({n for e in edges.collect() for n in e[:2]})
    assert {(r.x < r.y, r.n) for r in both.groupBy((F.col("x") < F.col("y")).alias("up"), "x", "y").agg(F.count("*").alias("n")).collect()} == {(True, 1), (False, 1)}
    labels = names.select("node", F.col("node").alias("community"))
    votes = ends.with_labels(both, labels.toDF("y", "community"), "y", True).groupBy("x", "community").agg(F.sum("w"))
    assert "hashpartitioning(x" not in votes._jdf.queryExecution().executedPlan().toString()
    # beyond the bound of a broadcast the sums are the same
    want = {tuple(r) for r in votes.collect()}
    shuffled = ends.with_labels(both, labels.toDF("y", "community"), "y", False).groupBy("x", "community").agg(F.sum("w"))
    assert {tuple(r) for r in shuffled.collect()} == want


def test_propagation_is_the_plain_one(spark):
    edges = planted(6, 3, 7, 0.5, 0.1)
    got = {r.node: r.community for r in graph.propagated(spark.createDataFrame(edges, EDGES)).collect()}
    near = defaultdict(lambda: defaultdict(int))
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    for n, v in near.items():  # settled: no label around has more weight, or as much and a smaller name
        votes = defaultdict(int, {got[n]: 1})
        for m, w in v.items():
            votes[got[m]] += w
        assert got[n] == min(votes, key=lambda c: (-votes[c], c))


@pytest.mark.parametrize("turns", [0, graph.TURNS])
def test_propagation_always_settles(spark, monkeypatch, turns):
    """Fixed turns let neighbours of one turn swap labels for ever; where no turns are left, no two neighbours move at once."""
    monkeypatch.setattr(graph, "TURNS", turns)
    edges = planted(3, 1, 20, 0.25, 0.0)
    got = {r.node: r.community for r in graph.propagated(spark.createDataFrame(edges, EDGES)).collect()}
    for n in got:
        votes = defaultdict(int, {got[n]: 1})
        for a, b, w in edges:
            if n in (a, b):
                votes[got[b if n == a else a]] += w
        assert got[n] == min(votes, key=lambda c: (-votes[c], c))
