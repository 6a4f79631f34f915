"""The news data model over the given tables.

articles come from documents and labels, sources from their origins, mentions from
capitalised words (a stand-in for a recogniser of names, which is a model), nodes, edges and
triples from mentions. DuckDB definitions of the same views are in brindle.plans.prelude.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import content_hash
from brindle.session import cut_lineage, next_round

#: Capitalised words of four letters or more stand for names.
NAME = "[A-Z][a-z]{3,}"
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
#: Shorter contents count as failed extractions.
LEAST_CHARS = 50


class Views:
    """Lazily built DataFrames of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """Everything of an article that its own row tells: a scan without joins."""
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.substring("source", 4, 20).cast("long").alias("source_id"),
            F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 500).alias("title"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
            content_hash(F.col("text")).alias("content_hash"),
            F.col("n_chars"),
            F.expr(f"timestampadd(MINUTE, doc_id * 97, {EPOCH})").alias("discovered_at"),
            F.expr(f"CASE WHEN lang <> 'en' THEN timestampadd(HOUR, -(n_chars % 48), timestampadd(MINUTE, doc_id * 97, {EPOCH})) END").alias("published_at"),
        )

    @cached_property
    def states(self) -> DataFrame:
        """(id, content_hash, status, duplicate_of_id) of each different (id, hash), from hashes and lengths alone.

        Copies meet by hash after each task has dropped its own, and the smallest id is joined back
        to them, which AQE splits where a hash is common. Articles without a text are copies of each other.
        """
        slim = cut_lineage(self.texts.select("id", "content_hash", (F.length("content") < LEAST_CHARS).alias("short")).distinct())
        key = F.coalesce("content_hash", F.lit("")).alias("key")
        first = slim.groupBy(key).agg(F.min("id").alias("first_id"))
        status = F.expr("CASE WHEN id > first_id THEN 'duplicate' WHEN short THEN 'failed' ELSE 'analyzed' END")
        return slim.withColumn("key", key).join(first, "key").select("id", "content_hash", status.alias("status"), F.expr("CASE WHEN id > first_id THEN first_id END").alias("duplicate_of_id"))

    @cached_property
    def articles(self) -> DataFrame:
        """texts with status and sentiment; whole contents go through the joins if a query reads them above. One that derives something from contents puts it on texts, and takes articles_of() that."""
        return self.articles_of(self.texts)

    def found(self, request) -> DataFrame:
        """The articles with a request's words, with their rank and without contents: words are looked for before anything is joined."""
        from brindle.operators.search import scored

        return self.articles_of(scored(self.texts, request))

    def articles_of(self, texts: DataFrame) -> DataFrame:
        """Rows made of texts, with id and content_hash, and their status and sentiment."""
        labels = self.table("labels").select(
            F.col("doc_id").alias("id"),
            F.expr("CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 1 THEN 'pos' WHEN quality = 0 THEN 'neutral' END").alias("sentiment_label"),
            F.expr("CASE WHEN toxic = 1 THEN -0.6D WHEN quality = 1 THEN 0.6D WHEN quality = 0 THEN 0.0D END").alias("sentiment_score"),
        )
        told = self.states.join(labels, "id", "left").withColumn("hash_key", F.coalesce("content_hash", F.lit(""))).drop("content_hash")
        return texts.withColumn("hash_key", F.coalesce("content_hash", F.lit(""))).join(told, ["id", "hash_key"]).drop("hash_key")

    @cached_property
    def visible(self) -> DataFrame:
        return self.articles.where(~F.col("status").isin("failed", "duplicate"))

    def visible_rows(self, rows: DataFrame) -> DataFrame:
        """Those of some rows, with id and content_hash, whose article is visible."""
        keys = ("id", F.coalesce("content_hash", F.lit("")).alias("hash_key"))
        seen = self.states.where(~F.col("status").isin("failed", "duplicate")).select(*keys)
        return rows.withColumn("hash_key", keys[1]).join(seen, ["id", "hash_key"], "left_semi").drop("hash_key")

    @cached_property
    def sources(self) -> DataFrame:
        """id, name, enabled, last_scanned_at."""
        per = self.articles.groupBy("source_id").agg(F.max("discovered_at").alias("last_scanned_at"))
        return per.select(F.col("source_id").alias("id"), F.concat(F.lit("source "), F.col("source_id")).alias("name"), (F.col("source_id") != 7).alias("enabled"), "last_scanned_at")

    @cached_property
    def mentions(self) -> DataFrame:
        """article_id, text, label, start, stop, confidence, canonical, node: each surface form once per article, found in one pass over texts and written, as nodes, edges and triples all read them."""
        from brindle.operators.graph import found_mentions

        return next_round(found_mentions(self.texts, NAME))

    @cached_property
    def mentions_with_status(self) -> DataFrame:
        return self.mentions.join(self.states.select(F.col("id").alias("article_id"), "status").distinct(), "article_id")

    @cached_property
    def titles(self) -> DataFrame:
        """(article_id, node) of names in titles."""
        found = self.visible.select(F.col("id").alias("article_id"), "discovered_at", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(NAME), F.lit(0)))).alias("text"))
        return found.select("article_id", "discovered_at", F.lower("text").alias("node"))

    @cached_property
    def nodes(self) -> DataFrame:
        from brindle.operators.graph import resolve_nodes

        return resolve_nodes(self.mentions)

    @cached_property
    def edges(self) -> DataFrame:
        from brindle.operators.graph import cooccurrence_edges

        return cooccurrence_edges(self.mentions)

    @cached_property
    def triples(self) -> DataFrame:
        """Named relations between neighbouring names: the connecting word's length picks the predicate (the texts have no phrases)."""
        from brindle.operators.graph import neighbour_triples

        return neighbour_triples(self.mentions)

    @cached_property
    def story_articles(self) -> DataFrame:
        """(story_id, article_id): articles that share their title's first name are one story, numbered by the smallest article."""
        return self.stories_of(self.visible)

    def stories_of(self, visible: DataFrame) -> DataFrame:
        """(story_id, article_id) of visible articles (id, title)."""
        first = visible.select(F.col("id").alias("article_id"), F.lower(F.regexp_extract("title", f"({NAME})", 1)).alias("key")).where("key <> ''")
        least = first.groupBy("key").agg(F.min("article_id").alias("story_id"), F.count("*").alias("n")).where("n > 1")
        return first.join(least, "key").select("story_id", "article_id")
