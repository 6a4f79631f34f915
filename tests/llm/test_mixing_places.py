"""Places of replicas depend on rows alone."""

import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing

DOC = "doc_id long, text string, source string"


def placed(df):
    """partition -> its rows in order."""
    out = {}
    for r in df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "doc_id", "text", "replica").orderBy("i").collect():
        out.setdefault(r.p, []).append((r.doc_id, r.text, r.replica))
    return out


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_same_placement_whatever_the_order_of_the_input(spark, apart):
    rows = [(i % 40 if i % 7 else None, f"text {i}", "abc"[i % 3]) for i in range(120)] + [(1, "twice", "a")] * 2
    df = spark.createDataFrame(rows, DOC)
    weights = {"a": 60.0, "b": 1.0, "c": 1.0}  # the rate of a is drawn in parts
    first = placed(mixing.shuffled(mixing.poisson_replicas(df.repartition(2), weights, total=10.0)))
    other = placed(mixing.shuffled(mixing.poisson_replicas(df.orderBy(F.rand(3)).repartition(5), weights, total=10.0)))
    assert first == other and sum(map(len, first.values())) > 500 and len(first) > 1


def test_maps_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "t", "s", {"a": 1}, 5)], "doc_id long, text string, source string, m map<string,int>, place int")
    found = mixing.shuffled(mixing.poisson_replicas(df, total=20.0))
    assert found.columns[:5] == df.columns and found.count() > 0
