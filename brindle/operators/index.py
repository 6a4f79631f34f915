"""An inverted index for many searches: postings by term, and conjunctions by counting the terms that meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.search import WEIGHT, ZETA2


#: Terms that are sent to all tasks.
MOST_TERMS = 200_000


def postings(articles_with_tokens: DataFrame, key: str = "id") -> DataFrame:
    """(term, id, positions): where each term stands; dealt and sorted by term, so that a written index is read by its ranges."""
    each = articles_with_tokens.select(key, F.posexplode("tokens").alias("at", "term"))
    return each.groupBy("term", key).agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))


def counted(articles_with_tokens: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """(term, keys..., n): how often each of some terms stands in an article; all others are left out before anything is shuffled, unless there are too many terms to send to all tasks."""
    asked = terms.select("term").distinct()
    each = articles_with_tokens.select(*keys, F.explode("tokens").alias("term"))
    met = each.join(F.broadcast(asked), "term") if asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS else each.join(asked, "term")
    return met.groupBy("term", *keys).agg(F.count("*").alias("n"))


def write_postings(articles_with_tokens: DataFrame, path: str, key: str = "id") -> None:
    postings(articles_with_tokens, key).repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(path)


def loaded(index: DataFrame, partitions: int, key: str = "id") -> DataFrame:
    """The index in memory, all postings of an article in one partition and sorted by term, so that a search is one stage without an exchange.

    A partition's batches know their least and greatest term, and those without a searched term are passed over. Memory (or disk, where it
    is short) grows with the corpus over all executors; ``partitions`` should grow with both.
    """
    single = F.aggregate(F.sequence(F.lit(1), F.size("positions")), F.lit(0.0), lambda a, j: a + WEIGHT / (j * j)) / ZETA2
    dealt = index.withColumn("single", single).repartition(partitions, key).sortWithinPartitions("term")
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)


def search_one(index: DataFrame, terms: Sequence[str], k: int = 20, key: str = "id") -> DataFrame:
    """(id, rank): the k best articles of a loaded index that have all of some different words; no words find none."""
    words = list(dict.fromkeys(terms))
    met = index.where(F.col("term").isin(*words)).groupBy(key).agg(F.count("*").alias("have"), F.sum("single").alias("r"))
    return met.where(F.col("have") == len(words)).select(key, F.bround(F.col("r") / max(len(words), 1), 4).alias("rank")).orderBy(F.desc("rank"), key).limit(k)


def search_many(index: DataFrame, queries: DataFrame, key: str = "id") -> DataFrame:
    """(query_id, id, rank) of every query's articles that have all of its terms.

    index: postings, or counted() ones. queries: query_id, terms (different words). The rank is the mean of the single-term ranks; the ids of
    common terms are never gathered, each (query, article) is one group.
    """
    each = queries.select("query_id", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    n = F.col("n").cast("int") if "n" in index.columns else F.size("positions")
    single = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, j: a + WEIGHT / (j * j)) / ZETA2
    met = each.join(index.select("term", key, single.alias("r")), "term").groupBy("query_id", key, "need").agg(F.count("*").alias("have"), F.sum("r").alias("r"))
    return met.where("have = need").select("query_id", key, F.bround(F.col("r") / F.col("need"), 4).alias("rank"))
