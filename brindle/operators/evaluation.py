"""Measures of results: precision and recall, latencies, throughput, merges, memory; and samples."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage, next_round


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 columns from tp, fp, fn; 0 where undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1": F.bround(share(2 * p * r, p + r), 4)})


def ner_prf(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("id", "start", "stop", "type")) -> DataFrame:
    """Strict scores by language and type, by type, by language, and in all (null keys are totals); both have lang and the keys."""
    g = gold.select("lang", *keys).distinct().withColumn("g", F.lit(1))
    p = predicted.select("lang", *keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, ["lang", *keys], "full")
    cube = both.cube("lang", "type").agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    return prf(cube)


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean F1 over languages that have anything."""
    return scores.where("lang is not null and type is null and tp + fp + fn > 0").agg(F.bround(F.avg("f1"), 4).alias("macro_f1"))


def relaxed_matches(gold: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, type, tp, fp, fn): within an article and type, predictions take the free gold span of greatest overlap above ``least``, in order."""
    rows = gold.select("id", "type", "start", "stop", F.lit(1).alias("is_gold")).union(predicted.select("id", "type", "start", "stop", F.lit(0)))

    def matched(g: list[tuple], p: list[tuple]) -> int:
        free, starts, tp = [True] * len(g), [a for a, _ in g], 0
        longest = max((b - a for a, b in g), default=0)
        for a, b in p:
            # only spans that overlap reach a share of 0 or more
            near = range(bisect_left(starts, a - longest), bisect_left(starts, b)) if least >= 0 else range(len(g))
            iou = [((min(b, g[i][1]) - max(a, g[i][0])) / (max(b, g[i][1]) - min(a, g[i][0])), -i) for i in near if free[i]]
            top = max(iou, default=(0.0, 0))
            if top[0] > least:
                free[-top[1]] = False
                tp += 1
        return tp

    kinds = dict(gold.dtypes)
    names = ["id", "type", "tp", "fp", "fn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans, out = None, ([], []), []

        def closed() -> tuple:
            tp = matched(spans[1], spans[0])
            return *at, tp, len(spans[0]) - tp, len(spans[1]) - tp

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            types = [batch.schema.field("id").type, pa.string()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate(types)], names)

        batch = None
        for batch in batches:
            for id_, kind, a, b, is_gold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (id_, kind):
                    if at is not None:
                        out.append(closed())
                    at, spans = (id_, kind), ([], [])
                spans[is_gold].append((a, b))
            if out:
                yield made(batch)
                out = []
        if at is not None:
            out.append(closed())
            yield made(batch)

    # many small groups in one pass over a sorted part: a call for each of them takes far longer than their work
    parts = rows.repartition("id", "type").sortWithinPartitions("id", "type", "start", "stop")
    return parts.mapInArrow(run, f"id {kinds['id']}, type string, tp long, fp long, fn long")


#: Parts into which a range of values is cut at a time, and values of a range that are put in order.
PARTS, MOST_ORDERED = 1024, 10_000


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, share, value): interpolated percentiles of each group, by selecting ranks; no group's values are gathered.

    The values of a group are counted in equal parts of their range; the part that holds a wanted rank is the next range, until it has few values
    or only one different. Those few are put in order. A null group is a group. Nulls and values that aren't finite are left out; groups without others give no row.
    """
    base = rows.select(F.struct(F.col(by).alias("k")).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    per = base.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    at = F.col("share") * (F.col("n") - 1)
    both = F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank")
    ranges = next_round(per.select("*", wanted).select("*", both).select("g", "share", "n", F.col("rank").alias("all"), "rank", "lo", "hi", F.col("n").alias("c")).distinct())
    while True:
        wide = (F.col("c") > MOST_ORDERED) & (F.col("lo") < F.col("hi"))
        open_ = ranges.where(wide)
        if open_.isEmpty():
            break
        spans = cut_lineage(open_.select("g", "lo", "hi").distinct())
        sent = F.broadcast(spans) if spans.limit(10_001).count() <= 10_000 else spans
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))  # halves don't overflow
        counted = base.join(sent, "g").where("v between lo and hi").groupBy("g", "lo", "hi", part.alias("part"))
        counted = counted.agg(F.count("*").alias("c"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        order = Window.partitionBy("g", "lo", "hi").orderBy("part")  # PARTS rows at most
        counted = counted.withColumn("before", F.sum("c").over(order) - F.col("c"))
        found = open_.drop("c").join(counted, ["g", "lo", "hi"]).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        found = found.select("g", "share", "n", "all", (F.col("rank") - F.col("before")).alias("rank"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "c")
        ranges = next_round(ranges.where(~wide).unionByName(found))
    single = ranges.where("lo = hi").select("g", "share", "n", "all", F.col("lo").alias("x"))
    few = ranges.where("lo < hi")
    spans = cut_lineage(few.select("g", "lo", "hi").distinct())
    sent = F.broadcast(spans) if spans.limit(10_001).count() <= 10_000 else spans
    place = F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")) - 1  # MOST_ORDERED rows at most
    ordered = base.join(sent, "g").where("v between lo and hi").withColumn("rank", place)
    each = single.unionByName(few.join(ordered, ["g", "lo", "hi", "rank"]).select("g", "share", "n", "all", F.col("v").alias("x")))
    pos = F.col("share") * (F.col("n") - 1)
    low, high = F.max(F.when(F.col("all") == F.floor(pos), F.col("x"))), F.max(F.when(F.col("all") == F.ceil(pos), F.col("x")))
    ends = each.groupBy("g", "share", "n").agg(low.alias("low"), high.alias("high"))
    exact = F.when(F.floor(pos) == F.ceil(pos), F.col("low")).otherwise((F.ceil(pos) - pos) * F.col("low") + (pos - F.floor(pos)) * F.col("high"))
    return ends.select(F.col("g.k").alias(by), "share", exact.alias("value"))


def latency_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Interpolated median and 95th percentile, and the mean."""
    found = percentiles(rows, by, value, (0.5, 0.95)).groupBy(by).agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("value"))), 4).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))])
    all_ = rows.groupBy(by).agg(F.round(F.avg(value), 4).alias("mean"), F.count("*").alias("n"))
    return all_.join(found.withColumnRenamed(by, "__by"), all_[by].eqNullSafe(F.col("__by")), "left").select(by, "p50", "p95", "mean", "n")


def throughput(rows: DataFrame) -> DataFrame:
    """Mean and population deviation by replicas, and the speed-up over one replica."""
    per = rows.groupBy("replica_count").agg(F.avg("articles_per_min").alias("mean"), F.stddev_pop("articles_per_min").alias("std"))
    one = rows.where("replica_count = 1").agg(F.avg("articles_per_min")).first()[0]  # a single number
    return per.select("replica_count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round(F.col("mean") / F.lit(one), 4).alias("speedup"))


def merge_shares(rows: DataFrame) -> DataFrame:
    """Percentages of labels by strategy, of labelled rows or else of all."""
    n = F.when(F.count("label") > 0, F.count("label")).otherwise(F.count("*"))
    return rows.groupBy("strategy").agg(*[F.bround(100.0 * F.count_if(F.col("label") == x) / n, 1).alias(x) for x in ("correct_merge", "false_merge", "ambiguous")])


def resource_peaks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("service").agg(F.max("memory_mb").alias("peak"), F.bround(F.avg("memory_mb"), 4).alias("mean"))


def stratified_sample(articles: DataFrame, per_language: int = 50, most_per_source: float = 0.4, seed: int = 1) -> DataFrame:
    """So many per language in hashed order, at most a share of them from one source; what is short is filled up regardless of source.

    Ranks come from one window per language and source, over keys only.
    """
    from pyspark.sql import Window

    place = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"), 256)
    rows = articles.select("id", "language", "source_id").withColumn("place", place)
    own = F.row_number().over(Window.partitionBy("language", "source_id").orderBy("place"))
    cap = max(1, int(per_language * most_per_source))
    ranked = rows.withColumn("over", F.when(own <= cap, 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("language").orderBy("over", "place"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= per_language).select("id", "language", "source_id")
