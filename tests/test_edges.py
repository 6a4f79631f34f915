"""Edges of mentions: tasks grow with the pairs, long articles are cut, and each pair is counted once."""

import random
from collections import Counter
from itertools import combinations

from brindle.operators import graph
from brindle.plans.registry import QUERIES
from brindle.sources.views import Views


def test_edges_in_small_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "NODES", 4)
    monkeypatch.setattr(graph, "PAIRS", 50)
    r = random.Random(5)
    sets = {i: {f"n{int(60 * r.random() ** 2)}" for _ in range(r.choice((0, 1, 2, 9, 30)))} for i in range(60)}
    rows = [(i, n) for i, s in sets.items() for n in s] * 2 + [(None, "n1"), (None, "n2"), (3, None)]
    want = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    edges = graph.cooccurrence_edges(spark.createDataFrame(rows, "article_id long, node string"))
    assert {(e.a, e.b): e.weight for e in edges.collect()} == dict(want) and edges.count() == len(want)
    # was spark.sql.shuffle.partitions or fewer however many pairs there were
    assert edges.rdd.getNumPartitions() == -(-sum(want.values()) // 50)
    assert graph.cooccurrence_edges(spark.createDataFrame([], "article_id long, node string")).count() == 0


def test_edges_of_a_label_are_named_without_a_join(spark):
    """Nodes that are joined may be broadcast, which takes them through the driver."""
    v = Views(spark, "/root/testdata/sf0.001")
    found, plain = QUERIES["graph_touching_label"](spark, v.sf_dir), graph.touching(v.edges, v.nodes, "PER")
    assert found.columns == plain.columns and [f.dataType for f in found.schema] == [f.dataType for f in plain.schema]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and not found.isEmpty()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
