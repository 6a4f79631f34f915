"""Communities of a weighted graph by modularity, in levels.

A level moves nodes between communities, then each community becomes a node of the next level, whose
edges are the sums of those between communities; what lies within is a loop. A round of moves is a few
joins and aggregations over edges: every node weighs its neighbours' communities by the modularity that
it would gain there. Nodes take turns by hash, so that neighbours seldom move at once on old sums, and
of two lone nodes only the one of the larger name moves. A round that lowers modularity is taken back, and from then on only
moves are made that touch different communities, which can't get in each other's way. Nodes are numbers in the order of their names
while this goes on, and edges are written once a level, dealt by their first end. Only sums and counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ends import by_first, few, numbered_ends, with_labels
from brindle.session import next_round

#: A level ends where all moves together promise, or a round of moves that can't get in each other's way brings, less modularity than this.
LEAST_GAIN = 1e-3


def _step(both: DataFrame, labels: DataFrame, total: float, small: bool) -> DataFrame:
    """(node, community, degree, loop, inner, best, gain) of each node under the labels (node, community, degree, loop).

    inner is its weight to its own community, loops included; gain is what moving to ``best`` adds to the weight within communities above what chance would give.
    Votes are added up where a node's edges lie, so that edges are read and never shuffled, as long as labels can be broadcast.
    """
    known = next_round(labels.join(labels.groupBy("community").agg(F.sum("degree").alias("all"), F.count("*").alias("size")), "community"))
    sums = known.groupBy("community").agg(F.first("all").alias("all"), F.first("size").alias("size"))
    votes = with_labels(both.where("x <> y"), known.select(F.col("node").alias("y"), "community"), "y", small).groupBy(F.col("x").alias("node"), "community").agg(F.sum("w").alias("w"))
    own = known.select(F.col("community").alias("own"), "node", "degree", "loop", F.col("all").alias("own_all"), F.col("size").alias("own_size"))
    votes = with_labels(with_labels(votes, sums, "community", small), own, "node", small)
    value = lambda w, rest: w - F.col("degree") * rest / total
    there = F.col("community") != F.col("own")
    # two nodes on their own would swap places
    allowed = there & ((F.col("size") > 1) | (F.col("own_size") > 1) | (F.col("community") < F.col("own")))
    best = F.min(F.when(allowed, F.struct((-value(F.col("w"), F.col("all"))).alias("minus"), "community")))
    told = votes.groupBy("node").agg(best.alias("best"), F.max(F.when(~there, F.col("w"))).alias("w_own"))
    rows = own.join(told, "node", "left").withColumn("w_own", F.coalesce("w_own", F.lit(0.0)))
    gain = -F.col("best.minus") - value(F.col("w_own"), F.col("own_all") - F.col("degree"))
    return rows.select("node", F.col("own").alias("community"), "degree", "loop", (F.col("w_own") + F.col("loop")).alias("inner"), F.col("best.community").alias("best"), F.coalesce(gain, F.lit(0.0)).alias("gain"))


def _quality(step: DataFrame, total: float) -> tuple[float, int, float]:
    """(modularity, communities, what it would rise by if every move brought its gain)."""
    each = step.groupBy("community").agg(F.sum("inner").alias("inner"), F.sum("degree").alias("degree"), F.sum(F.greatest("gain", F.lit(0.0))).alias("gain"))
    row = each.agg(F.sum("inner").alias("i"), F.sum(F.col("degree") * F.col("degree")).alias("d"), F.count("*").alias("n"), F.sum("gain").alias("g")).first()
    return row["i"] / total - row["d"] / (total * total), row["n"], 2 * row["g"] / total


def _apart(step: DataFrame) -> DataFrame:
    """The step with ``moves``: whether a node's move is the best of all that touch the community it leaves, and of all that touch the one it joins.

    Such moves touch each community once at most, so that together they raise modularity by the sum of their gains.
    """
    wanted = step.where("gain > 1e-9").select("node", "gain", "community", "best")
    touched = wanted.select(F.explode(F.array("community", "best")).alias("at"), F.struct("gain", "node").alias("move"))
    first = touched.groupBy("at").agg(F.max("move.gain").alias("gain"), F.max_by("move.node", "move").alias("node"))
    both = first.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node", F.lit(True).alias("moves"))
    return step.join(both, "node", "left").withColumn("moves", F.coalesce("moves", F.lit(False)))


def _level(both: DataFrame, total: float, most_rounds: int, small: bool) -> tuple[DataFrame, float, int]:
    """(labels, modularity, communities) of a level's nodes, each of which begins on its own."""
    sums = both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("loop"))
    best = next_round(_step(both, sums.select("node", F.col("node").alias("community"), "degree", "loop"), total, small))
    quality, communities, hope = _quality(best, total)
    careful = False
    for round_ in range(most_rounds):
        if hope < LEAST_GAIN:
            break
        asked = _apart(best) if careful else best.withColumn("moves", (F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(2)) == 0) & (F.col("gain") > 1e-9))
        moved = F.when(F.col("moves"), F.col("best")).otherwise(F.col("community"))
        step = next_round(_step(both, asked.select("node", moved.alias("community"), "degree", "loop"), total, small))
        now, n, ahead = _quality(step, total)
        if now - quality < LEAST_GAIN:  # moves got in each other's way, or little is left
            if careful:
                break
            careful = True
        if now > quality:
            best, quality, communities, hope = step, now, n, ahead
    return best.select("node", "community"), quality, communities


def _contracted(both: DataFrame, labels: DataFrame, small: bool) -> DataFrame:
    ends = [labels.select(F.col("node").alias(c), F.col("community").alias(f"{c}_in")) for c in "xy"]
    inner = with_labels(with_labels(both, ends[1], "y", small).groupBy("x", "y_in").agg(F.sum("w").alias("w")), ends[0], "x", small)
    sums = next_round(inner.groupBy(F.col("x_in").alias("x"), F.col("y_in").alias("y")).agg(F.sum("w").alias("w")))
    return by_first(sums, sums.count())


def levels(edges: DataFrame, most_levels: int = 10, most_rounds: int = 12) -> DataFrame:
    """(node, level, community) of undirected edges (a, b, weight): the communities after each level, named by their smallest node.

    Level 1 is the finest. Repeated edges add up, loops belong to their node's weight, and edges with a null end or
    without a positive weight are left out. Modularity never falls from level to level. An empty table gives no rows.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("weight") > 0)).select("a", "b", F.col("weight").cast("double").alias("w"))
    both, names = numbered_ends(e)
    total, small = both.agg(F.sum("w")).first()[0], few(names)
    if not total:
        return names.select(F.col("name").alias("node"), F.lit(1).alias("level"), F.col("name").alias("community"))
    out, quality, at = [], None, None
    for level in range(1, most_levels + 1):
        labels, now, communities = _level(both, total, most_rounds, small)
        if quality is not None and now - quality < LEAST_GAIN:
            break
        quality = now
        at = labels if at is None else at.join(labels.toDF("community", "next"), "community").select("node", F.col("next").alias("community"))
        at = next_round(at)
        named = at.join(names.toDF("node", "name"), "node")
        least = named.groupBy("community").agg(F.min("name").alias("least"))
        out.append(named.join(least, "community").select(F.col("name").alias("node"), F.lit(level).alias("level"), F.col("least").alias("community")))
        if communities == 1:
            break
        both = _contracted(both, labels, small)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def communities(edges: DataFrame, level: int | None = None, **limits: int) -> DataFrame:
    """(node, community) of one level, or of the coarsest."""
    found = levels(edges, **limits)
    if level is None:
        return found.groupBy("node").agg(F.max_by("community", "level").alias("community"))
    return found.where(F.col("level") == level).select("node", "community")


def numbered(members: DataFrame, most: int = 10_000) -> DataFrame:
    """Communities of a drawing as numbers from 0, the largest first; more than ``most`` raise ValueError."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} communities are too many to draw")
    number: Column = F.lit(None).cast("int")
    if sizes:
        rows = members.sparkSession.createDataFrame([(r["community"], i) for i, r in enumerate(sizes)], "community string, number int")
        return members.join(F.broadcast(rows), "community").select("node", "community", "number")
    return members.withColumn("number", number)
