"""Edges for rounds that read them again and again: ends as numbers, written once, dealt by their first end."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import next_round, table_path

#: Edges of a bucket, and labels that are broadcast at most (some 60 bytes each); beyond that they are joined by a shuffle.
EDGES, LABELS = 500_000, 2_000_000


def by_first(rows: DataFrame, n: int) -> DataFrame:
    """The sums of n rows (x, y, w) as a table in buckets of x, so that sums for each x need no exchange; the number of buckets grows with n."""
    spark = rows.sparkSession
    buckets = min(ceil(n / EDGES), 100_000)
    buckets = max(buckets, min(n // 1000 + 1, spark.sparkContext.defaultParallelism))
    name = f"edges_{uuid.uuid4().hex}"
    sums = rows.repartition(buckets, "x").groupBy("x", "y").agg(F.sum("w").alias("w"))
    sums.write.bucketBy(buckets, "x").option("path", table_path(spark, "edges")).saveAsTable(name)
    return spark.table(name)


def few(nodes: DataFrame) -> bool:
    """Whether labels of so many nodes can be broadcast."""
    return nodes.limit(LABELS + 1).count() <= LABELS


def with_labels(rows: DataFrame, labels: DataFrame, on: str, small: bool) -> DataFrame:
    """rows with what labels, one for each value of ``on``, tell: broadcast only if their nodes were counted to be few, so that rows stay where they are."""
    return rows.join(F.broadcast(labels) if small else labels, on)


def numbered_ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((x, y, w) both ways as numbers, repeats added up, dealt by x; (node, name)) of edges (a, b, w). Numbers are in the order of names; a loop is there twice, as both of its ends count."""
    e = next_round(edges)
    ends = next_round(e.select(F.col("a").alias("name")).union(e.select("b")).where("name is not null").distinct())
    ids = next_round(ends.repartitionByRange("name").sortWithinPartitions("name").select(F.monotonically_increasing_id().alias("node"), "name"))
    small = few(ids)
    coded = with_labels(with_labels(e, ids.toDF("x", "a"), "a", small), ids.toDF("y", "b"), "b", small).select("x", "y", "w")
    one = coded.union(coded.select("y", "x", "w"))
    return by_first(one, 2 * e.count()), ids
