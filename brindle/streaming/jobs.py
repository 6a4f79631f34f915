"""Structured Streaming forms: file sources, event-time windows, first-seen filters, incremental alerts, retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators import alerts, graph, stories
from brindle.operators.pipeline import MOST_RETRIES
from brindle.session import cut_lineage
from brindle.sources.versions import Append, Buckets, Store, Version, bucket_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_of(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by window of event time; rows later than ``late`` are left out once their window is closed."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = timed.groupBy(F.window(at, width, slide) if slide else F.window(at, width), by).agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", at: str = "ts", by: str = "user_id") -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = timed.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), by, "n")


def first_seen(entries: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Entries whose key didn't occur within so long before."""
    return entries.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def alert_stream(articles: DataFrame, rules: DataFrame, mentions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each new (rule, article) pair once; pairs written before are looked up, so a batch that runs again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(path).select("rule_id", "article_id")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "rule_id long, article_id long")
        found = alerts.match(df, rules, mentions, known).dropDuplicates(["rule_id", "article_id"])
        found.write.mode("append").parquet(path)

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_stream(articles: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies a stage to whatever is new and appends its results: a polling worker as a stream."""
    return stage(articles).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_states(tries: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """(id, tries, status) after each batch of tries (id, failed): a counter per article that success resets."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        for pdf in batches:
            for failed in pdf["failed"]:
                count = count + 1 if failed else 0
        state.update((count,))
        status = "failed" if count >= most else "retry" if count else "done"
        yield pd.DataFrame({"id": [key[0]], "tries": [count], "status": [status]})

    return tries.groupBy("id").applyInPandasWithState(update, "id long, tries long, status string", "tries long", "update", "NoTimeout")


def drained(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.awaitTermination()


#: Buckets of the graph's tables; a batch replaces those that its keys fall in.
BUCKETS = 64


def _merged(store: Store, base: Version, table: str, keys: tuple[str, ...], delta: DataFrame, merge: Callable[[DataFrame], DataFrame], buckets: int) -> tuple[Buckets, tuple[int, ...]]:
    """A bucketed table with a batch's rows merged in: only the buckets of the batch's keys are read and replaced."""
    touched = tuple(sorted(r[0] for r in delta.select(bucket_of(keys, buckets)).distinct().collect()))
    rows = delta if table not in base.tables else store.read(table, base, touched).unionByName(delta)
    return Buckets(merge(rows), keys, buckets, touched), touched


def apply_recognised(store: Store, articles: DataFrame, recognise: Callable[[DataFrame], DataFrame], number: int, buckets: int = BUCKETS) -> Version:
    """A batch of articles through recognition, nodes, edges, triples and stories, and on to analysed: one version of all tables.

    ``recognise`` gives predictions as graph.intake() takes them. Each batch adds what it contributes: forms of names, weights of edges and new members of
    stories are merged with the stored rows of the same keys, in their buckets; texts and mentions of earlier batches aren't read. Batches are numbered
    upwards, and one that is known to the newest version changes nothing. A batch that dies leaves the version before it as it is. An article comes in
    one batch only.
    """
    base = store.latest()
    if number <= base.notes.get("batch", -1):
        return base
    batch = articles.dropDuplicates(["id"])
    found = cut_lineage(graph.intake(recognise(batch)).join(batch.select(F.col("id").alias("article_id"), "discovered_at"), "article_id"))
    forms = lambda df: df.groupBy("node", "canonical", "label", "text").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    new_forms = cut_lineage(graph.forms(found))
    all_forms, touched = _merged(store, base, "forms", ("node",), new_forms, forms, buckets)
    weights = lambda df: df.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    edges, _ = _merged(store, base, "edges", ("a", "b"), cut_lineage(graph.cooccurrence_edges(found)), weights, buckets)
    states = "story_id long, nodes array<string>, last_at timestamp_ntz, n long, mean double"
    known = store.read("stories", base) if "stories" in base.tables else store.spark.createDataFrame([], states)
    members = found.select("article_id", "node")
    assigned, stories_now = stories.continued(batch, members, known)
    stories_now = cut_lineage(stories_now.select("story_id", "nodes", F.col("last_at").cast("timestamp_ntz").alias("last_at"), F.col("n").cast("long").alias("n"), "mean"))
    story_buckets = tuple(sorted(r[0] for r in stories_now.select(bucket_of(("story_id",), buckets)).distinct().collect()))
    kept = known if "stories" not in base.tables else store.read("stories", base, story_buckets).join(stories_now.select("story_id"), "story_id", "left_anti").select(*stories_now.columns)
    changes = {
        "mentions": Append(found),
        "forms": all_forms,
        "nodes": Buckets(graph.nodes_of(all_forms.rows), ("node",), buckets, touched),
        "edges": edges,
        "triples": Append(graph.relationship_triples(batch, found)),
        "stories": Buckets(kept.unionByName(stories_now), ("story_id",), buckets, story_buckets),
        "story_articles": Append(assigned),
        "states": Append(batch.select("id", F.lit("analyzed").alias("status"))),
    }
    return store.commit(base, changes, batch=number)


def recognition_stream(articles: DataFrame, recognise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """apply_recognised() of each batch of a stream, into a store of versions at ``path``; a batch that runs again adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        apply_recognised(Store(df.sparkSession, path), df, recognise, number)

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
