"""Aggregations over articles, mentions and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.values import HIDDEN

LABELS = ("pos", "neg", "neutral")


def counted(label: str, column: str = "sentiment_label") -> Column:
    return F.count_if(F.col(column) == label)


def visible(articles: DataFrame) -> DataFrame:
    return articles.where(~F.col("status").isin(*HIDDEN))


def in_window(df: DataFrame, as_of: str | None, days: int, at: str = "discovered_at") -> DataFrame:
    """Rows of so many days before ``as_of``; 0 days means all."""
    return df if not days else df.where(F.col(at) >= F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days"))


def sentiment_over_time(articles: DataFrame, interval: str = "day", as_of: str | None = None, days: int = 0) -> DataFrame:
    """Counts by label and the average score per bucket; an unknown interval counts as day. The average is over the whole bucket."""
    unit = interval if interval in ("day", "week", "month") else "day"
    rows = in_window(visible(articles), as_of, days)
    return rows.groupBy(F.date_trunc(unit, "discovered_at").cast("timestamp_ntz").alias("bucket")).agg(*[counted(x).alias(x) for x in LABELS], F.bround(F.coalesce(F.avg("sentiment_score"), F.lit(0.0)), 4).alias("avg_score"))


def label_over_time(articles: DataFrame, interval: str = "day") -> DataFrame:
    """The same by bucket and label."""
    rows = visible(articles).groupBy(F.date_trunc(interval, "discovered_at").cast("timestamp_ntz").alias("bucket"), "sentiment_label")
    return rows.agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg("sentiment_score"), F.lit(0.0)), 4).alias("avg_score"))


def language_mix(articles: DataFrame, interval: str = "day") -> DataFrame:
    return visible(articles).groupBy(F.date_trunc(interval, "discovered_at").cast("timestamp_ntz").alias("bucket"), F.coalesce("language", F.lit("und")).alias("language")).agg(F.count("*").alias("n"))


def trending(mentions: DataFrame, as_of: str, days: int, k: int = 20) -> DataFrame:
    rows = in_window(mentions, as_of, days).groupBy("node").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "node").limit(k)


def sentiment_distribution(articles: DataFrame) -> DataFrame:
    rows = articles.where("sentiment_label is not null").groupBy("sentiment_label")
    return rows.agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg("sentiment_score"), F.lit(0.0)), 4).alias("avg_score"))


def sentiment_by_language(articles: DataFrame) -> DataFrame:
    return articles.where("sentiment_label is not null").groupBy("language", "sentiment_label").agg(F.count("*").alias("n"))


def sentiment_by_language_map(articles: DataFrame) -> DataFrame:
    """One row per language with a map of label to count."""
    each = sentiment_by_language(articles)
    return each.groupBy("language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sentiment_label", "n")))).alias("counts"))


def top_entities(mentions: DataFrame, k: int = 50) -> DataFrame:
    return mentions.groupBy("text", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text", "label").limit(k)


def entity_stats(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("label").agg(F.count("*").alias("n"))


def status_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status").agg(F.count("*").alias("n"))


def health_counts(articles: DataFrame, sources: DataFrame) -> DataFrame:
    rows = articles.select(F.lit(1).alias("a"), F.lit(0).alias("s"), F.lit(0).alias("e")).union(sources.select(F.lit(0), F.lit(1), F.when(F.col("enabled"), 1).otherwise(0)))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("a", "articles"), ("s", "sources"), ("e", "enabled_sources"))])


def overview_totals(articles: DataFrame) -> DataFrame:
    return visible(articles).agg(*[counted(x).alias(x) for x in LABELS])


def source_credibility(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals and rates per source, sources without articles included; reliability is the product of what didn't fail and what wasn't copied."""
    per = articles.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "duplicate").alias("duplicate"))
    rows = sources.join(per, "id", "left").na.fill(0, ["total", "failed", "duplicate"])
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return rows.withColumns({"failed_rate": F.bround(rate("failed"), 4), "duplicate_rate": F.bround(rate("duplicate"), 4), "reliability": F.bround((1.0 - rate("failed")) * (1.0 - rate("duplicate")), 4)})


def source_grades(credibility: DataFrame, as_of: str) -> DataFrame:
    """Score 0-100 and grade from reliability and the whole days since the last scan."""
    days = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("last_scanned_at").cast("timestamp"))) / 86400)
    recency = F.when(F.col("last_scanned_at").isNull(), 0.7).otherwise(F.greatest(F.lit(0.5), 1.0 - days / 30.0))
    graded = credibility.withColumn("score", F.bround(100.0 * F.col("reliability") * recency, 1))
    s = F.col("score")
    return graded.withColumn("grade", F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 50, "C").when(s >= 30, "D").otherwise("F"))


def watchlist_stats(watchlist: DataFrame, nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each watched node with its label, mentions in visible articles and the last of these; unknown nodes stay with zeros."""
    stats = mentions.where(~F.col("status").isin(*HIDDEN)).groupBy("node").agg(F.count("*").alias("mentions"), F.max("discovered_at").alias("last_mention"))
    return watchlist.join(nodes.select("node", "label"), "node", "left").join(stats, "node", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def overview(articles: DataFrame, mentions: DataFrame, interval: str = "day", as_of: str | None = None, days: int = 0, k: int = 20) -> dict[str, DataFrame]:
    """The whole answer of an overview: sentiment and languages by bucket, trending nodes, totals."""
    rows = in_window(articles, as_of, days)
    return {
        "sentiment_over_time": sentiment_over_time(articles, interval, as_of, days),
        "language_mix": language_mix_pivot(rows, interval),
        "trending": trending(mentions, as_of, days, k),
        "totals": overview_totals(rows),
    }


def language_mix_pivot(articles: DataFrame, interval: str = "day") -> DataFrame:
    """A row per bucket and a column per language that occurs, unknown ones as und; languages are few, and are read first."""
    rows = language_mix(articles, interval)
    names = [r[0] for r in rows.select("language").distinct().orderBy("language").limit(1000).collect()]
    return rows.groupBy("bucket").pivot("language", names).agg(F.sum("n")).na.fill(0)
