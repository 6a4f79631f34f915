"""The graph batch by batch against the graph of all articles at once."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from brindle.operators import graph, stories
from brindle.sources.versions import Store
from brindle.streaming import jobs

ARTICLES = "id long, title string, content string, language string, sentiment_score double, discovered_at timestamp_ntz"
NAMES = ["Alpha", "Beta", "Gamma", "Delta", "Eps"]


def invented(seed, n):
    r, out, names = random.Random(seed), [], NAMES[:3]
    for i in range(n):
        if r.random() < 0.4:
            names = r.sample(NAMES, r.randint(1, 4))
        out.append((i, "t", " met with ".join(names) + ". More text.", "en", r.choice([None, 0.5, -0.5]), datetime(2024, 1, 1) + timedelta(hours=30 * i)))
    return out


def recognise(df):
    found = F.explode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("text")
    rows = df.select(F.col("id").alias("article_id"), "content", found).where("text <> 'More'")
    start = (F.instr(F.col("content"), F.col("text")) - 1).cast("long")
    return rows.select("article_id", "content", "text", F.lit("person").alias("label"), start.alias("start"), (start + F.length("text")).cast("long").alias("stop"), F.lit(0.9).alias("score"))


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_batches_add_up_to_the_whole(spark, tmp_path):
    rows = invented(1, 24)
    df = spark.createDataFrame(rows, ARTICLES)
    store = Store(spark, str(tmp_path / "store"))
    for k in range(3):
        v = jobs.apply_recognised(store, df.where(F.col("id").between(8 * k, 8 * k + 7)), recognise, k, buckets=4)
        assert v.number == k + 1
    assert jobs.apply_recognised(store, df.where("id > 15"), recognise, 2, buckets=4).number == 3  # known already
    found = graph.intake(recognise(df)).join(df.select(F.col("id").alias("article_id"), "discovered_at"), "article_id")
    node = ("node", "canonical", "label", "aliases", "mention_count", "first_seen", "last_seen")
    assert told(store.read("nodes"), *node) == told(graph.resolve_nodes(found), *node)
    assert told(store.read("edges"), "a", "b", "weight") == told(graph.cooccurrence_edges(found), "a", "b", "weight")
    triple = ("subject", "object", "predicate", "article_id", "confidence")
    assert told(store.read("triples"), *triple) == told(graph.relationship_triples(df, found), *triple)
    members = found.select("article_id", "node")
    whole = stories.story_assignment(df, members)
    assert told(store.read("story_articles"), "article_id", "story_id", "running_mean") == told(whole, "article_id", "story_id", "running_mean")
    state = {r.story_id: r for r in store.read("stories").collect()}
    sizes = {}
    for a, s, m in told(whole, "article_id", "story_id", "running_mean"):
        sizes[s] = sizes.get(s, 0) + 1
    assert {s: r.n for s, r in state.items()} == sizes and max(sizes.values()) > 2
    sets = {}
    for a, s, _ in told(whole, "article_id", "story_id", "running_mean"):
        sets.setdefault(s, set()).update(r.node for r in members.where(F.col("article_id") == a).collect())
    assert {s: set(r.nodes) for s, r in state.items()} == sets
    assert store.read("states").count() == 24
    # a stored version is whole: nodes and edges of the second batch belong together
    second = store.version(2)
    first_two = found.where("article_id < 16")
    assert told(store.read("edges", second), "a", "b", "weight") == told(graph.cooccurrence_edges(first_two), "a", "b", "weight")


def test_a_later_batch_reads_no_earlier_text(spark, tmp_path):
    rows = invented(2, 8)
    df = spark.createDataFrame(rows, ARTICLES)
    store = Store(spark, str(tmp_path / "store"))
    jobs.apply_recognised(store, df.where("id < 4"), recognise, 0, buckets=4)
    seen = []
    read = store.read

    def watched(table, *rest, **more):
        seen.append(table)
        return read(table, *rest, **more)

    store.read = watched
    jobs.apply_recognised(store, df.where("id >= 4"), recognise, 1, buckets=4)
    assert set(seen) <= {"forms", "edges", "stories"}
    assert pd.notna(store.latest().notes["batch"])
