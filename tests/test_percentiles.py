"""Percentiles by ranks against numpy, and no group gathered."""

import random

import numpy as np
import pytest

from brindle.operators import evaluation


@pytest.mark.parametrize(("most", "parts"), [(10_000, 1024), (3, 4)])
def test_ranks_are_those_of_all_values(spark, monkeypatch, most, parts):
    monkeypatch.setattr(evaluation, "MOST_ORDERED", most)
    monkeypatch.setattr(evaluation, "PARTS", parts)
    r = random.Random(3)
    groups = {"a": [r.gauss(0, 5) for _ in range(101)], "b": [1.5] * 40 + [2.5], "c": [7.0], None: [r.choice([1.0, 2.0, 1e300, -1e300]) for _ in range(30)], "d": [float(i % 7) for i in range(50)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None), ("c", float("inf"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {(x.g, x.share): x.value for x in evaluation.percentiles(df, "g", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == {(g, p) for g in groups for p in (0.0, 0.5, 0.95, 1.0)}
    for (g, p), value in got.items():
        assert value == pytest.approx(float(np.percentile(np.array(groups[g], np.longdouble), 100 * p)), rel=1e-9, abs=1e-9), (g, p)
    told = {x.g: (x.p50, x.n) for x in evaluation.latency_percentiles(df.where("v is null or not isnan(v)"), "g", "v").collect()}
    assert told["c"] == (7.0, 2) and told["e"] == (None, 1) and told[None][1] == 30


def test_no_values_are_gathered(spark):
    df = spark.range(50).selectExpr("id % 3 as g", "cast(id as double) as v")
    plan = evaluation.percentiles(df, "g", "v")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    assert evaluation.percentiles(df.limit(0), "g", "v").count() == 0
