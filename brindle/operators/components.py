"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the remaining edges; nothing
is collected to the driver but two counts. A hub's edges are joined with one
minimum per node, which AQE can split, and are never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import next_round


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(x, y) pairs with the smallest of x and all its y as m."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return pairs.join(least, "x")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for each node that has an edge; component is its smallest node.

    Nulls at either end and loops carry no link. Repeated edges count once. An
    empty table gives an empty result. Raises RuntimeError if the rounds don't
    settle within ``max_rounds`` (they need about the square of the logarithm of
    the longest path).
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = next_round(e)
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        large = _toward_minimum(both).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _toward_minimum(large.select(F.col("u").alias("x"), F.col("v").alias("y")))
        small = down.select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("x", "m"))
        e = next_round(small.distinct())
        # a star forest: every node has one parent, and no parent has one
        marks = e.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("v", F.lit(0), F.lit(1)))
        rough = marks.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)")
        if rough.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
