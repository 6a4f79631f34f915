"""Stories: clusters of articles that share entities."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage, next_round


def jaccard(a: str, b: str) -> F.Column:
    """Shared part of two arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


#: Members of a set that meet others in one row, and pairs of members that a task makes.
MEMBERS, MADE = 1000, 1_000_000


def jaccard_pairs(members: DataFrame, least: float = 0.5, key: str = "article_id", item: str = "node") -> DataFrame:
    """(a, b, shared, jaccard) of all pairs a < b that reach the threshold.

    Equal sets meet once. Sets are ordered from rare to common items. Two sets that reach it share one of the
    first n - ceil(least * n) + 1 items of either, so that only these are joined and
    items that very many have seldom meet. Pairs of sets are then written out to their members, in blocks: the result
    grows with the square of a set's members, but no task makes more than its share of it.
    """
    each = members.select(F.col(key).alias("k"), F.col(item).alias("x")).where("k is not null and x is not null").distinct()
    whole = each.groupBy("k").agg(F.array_sort(F.collect_set("x")).alias("s"))
    whole = next_round(whole.select("k", "s", F.sha2(F.to_json("s"), 256).alias("sid")))
    per = next_round(whole.groupBy("sid").agg(F.count("*").alias("n"), F.first("s").alias("s")))
    items = per.select("sid", F.explode("s").alias("x"))
    common = items.groupBy("x").agg(F.count("*").alias("f"))
    sets = items.join(common, "x").groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "x"))), lambda s: s["x"]).alias("s"))
    n = F.size("s")
    first = sets.select("sid", "s", F.explode(F.slice("s", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias("x"))
    met = first.toDF("i", "si", "x").join(first.toDF("j", "sj", "x"), "x").where("i < j")
    fair = (F.size("si") >= F.size("sj") * least - 1e-9) & (F.size("sj") >= F.size("si") * least - 1e-9)
    rows = met.where(fair).select("i", "j", F.size(F.array_intersect("si", "sj")).cast("long").alias("shared"), (F.size("si") + F.size("sj")).alias("both"))
    same = per.where("n > 1").select(F.col("sid").alias("i"), F.col("sid").alias("j"), F.size("s").cast("long").alias("shared"), (2 * F.size("s")).alias("both"))
    value = F.col("shared") / (F.col("both") - F.col("shared"))
    pairs = rows.union(same).where(value >= least).distinct().select("i", "j", "shared", F.bround(value, 4).alias("jaccard"))

    parts = per.select("sid", F.ceil(F.col("n") / MEMBERS).alias("parts"))
    block = F.pmod(F.xxhash64("k"), F.col("parts"))
    blocks = next_round(whole.join(parts, "sid").groupBy("sid", block.alias("block")).agg(F.collect_list("k").alias("ks")))
    side = lambda c: blocks.toDF(c, f"{c}_block", f"{c}_ks")
    # equal sets: each block with those not before it
    met = next_round(pairs.join(side("i"), "i").join(side("j"), "j").where("i <> j or i_block <= j_block"))
    made = met.agg(F.sum(F.size("i_ks").cast("long") * F.size("j_ks"))).first()[0] or 0
    dealt = met.repartition(ceil(made / MADE) or 1, "i", "i_block", "j", "j_block")
    one = dealt.select("i", "j", "i_block", "j_block", "shared", "jaccard", "j_ks", F.explode("i_ks").alias("a"))
    two = one.select("i", "j", "i_block", "j_block", "shared", "jaccard", "a", F.explode("j_ks").alias("b")).where("i <> j or i_block <> j_block or a < b")
    return two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "jaccard")


def _mean_after(n: int, mean: float | None, score: float | None) -> tuple[int, float | None]:
    """(n, mean) with one more member; members without a score count too."""
    if score is None or pd.isna(score):
        return n + 1, mean
    return n + 1, round(((mean or 0.0) * n + score) / (n + 1), 4)


def replay(articles: list[tuple], least: float = 0.5, least_shared: int = 2, days: int = 7) -> list[tuple[int, int, float | None]]:
    """(article_id, story_id, running mean score) of articles (id, seen, nodes, score) in order of (seen, id).

    An article joins the story of greatest Jaccard among those last seen within so
    many days; the older story wins ties. Else it begins one, numbered like itself.
    """
    stories: dict[int, dict] = {}
    by_node: dict = {}
    out = []
    for id_, seen, nodes, score in sorted(articles, key=lambda a: (a[1], a[0])):
        nodes = set(nodes)
        best, best_value = None, 0.0
        for s in sorted({s for n in nodes for s in by_node.get(n, ())}):
            story = stories[s]
            shared = len(story["nodes"] & nodes)
            value = shared / len(story["nodes"] | nodes)
            if shared >= least_shared and value >= least and value > best_value and seen - story["last"] <= pd.Timedelta(days=days):
                best, best_value = s, value
        if best is None:
            best = id_
            stories[best] = {"nodes": set(), "last": seen, "n": 0, "mean": None}  # the mean of no scores is told as none, and counts as 0
        story = stories[best]
        for n in nodes - story["nodes"]:
            by_node.setdefault(n, set()).add(best)
        story["nodes"] |= nodes
        story["last"] = max(story["last"], seen)
        story["n"], story["mean"] = _mean_after(story["n"], story["mean"], score)
        out.append((id_, best, story["mean"]))
    return out


def _rare_first(members: DataFrame, articles: DataFrame, numbered: bool = False) -> DataFrame:
    """(article_id, at, bucket, nodes) of articles with nodes and a time: nodes from rare to common, as numbers if asked for, which are shuffled for less than names."""
    each = members.where("article_id is not null and node is not null").select("article_id", "node").distinct()
    common = each.groupBy("node").agg(F.count("*").alias("f"))
    if numbered:  # a written table, so that numbers hold
        common = next_round(common.withColumn("number", F.monotonically_increasing_id()))
        named = each.join(common, "node").select("article_id", "f", F.col("number").alias("node"))
    else:
        named = each.join(common, "node")
    sets = named.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "node"))), lambda s: s["node"]).alias("nodes"))
    timed = articles.where("id is not null and discovered_at is not null").groupBy(F.col("id").alias("article_id")).agg(F.min("discovered_at").alias("at"))
    return sets.join(timed, "article_id")


def _shared_enough(sets: DataFrame, first: DataFrame, held: DataFrame, least: float, least_shared: int, days: int) -> DataFrame:
    """(article_id, at, bucket, story_id, value): stories that an article may join by nodes, as they are just before it.

    first: (story_id, node, first) with the first article that brought the node. An article that joins has so many nodes of the story that one of its
    rarest is among them, so only those look for stories, and only for stories of the same or the last stretch of ``days``.
    """
    n = F.size("nodes")
    need = F.greatest(F.ceil(n * least - 1e-9).cast("int"), F.lit(least_shared))
    asked = sets.where(n >= least_shared).select("article_id", "at", "bucket", F.explode(F.slice("nodes", F.lit(1), n - need + 1)).alias("node"))
    spans = held.groupBy("story_id").agg(F.min("bucket").alias("b0"), (F.max("bucket") + 1).alias("b1"))
    kept = first.join(spans, "story_id").select("story_id", "node", "first", F.explode(F.sequence("b0", "b1")).alias("bucket"))
    met = asked.join(kept, ["node", "bucket"]).where(F.col("first") < F.struct("at", "article_id")).select("article_id", "story_id").distinct()
    lists = first.groupBy("story_id").agg(F.collect_list(F.struct("node", "first")).alias("held"))  # no more than twice the nodes of its largest article
    both = met.join(sets, "article_id").join(lists, "story_id")
    own = F.struct("at", "article_id")
    before = both.withColumn("before", F.transform(F.filter("held", lambda x: x["first"] < own), lambda x: x["node"])).drop("held")
    shared = F.size(F.array_intersect("before", "nodes"))
    value = shared / (F.size("before") + n - shared)
    return before.where((shared >= least_shared) & (value >= least)).select("article_id", "at", "bucket", "story_id", value.alias("value"))


def _still_open(found: DataFrame, held: DataFrame, days: int) -> DataFrame:
    """Those of found whose story had its last article before them within so many days. The last one is a running maximum over a story's stretch, or the maximum of the stretch before."""
    both = held.select("story_id", "bucket", "at", "article_id", F.lit(1).alias("member"), F.lit(None).cast("double").alias("value"))
    both = both.unionByName(found.select("story_id", "bucket", "at", "article_id", F.lit(0).alias("member"), "value"))
    # an article that asks stands before itself as a member
    so_far = Window.partitionBy("story_id", "bucket").orderBy("at", "article_id", "member").rowsBetween(Window.unboundedPreceding, -1)
    asked = both.withColumn("near", F.max(F.when(F.col("member") == 1, F.col("at"))).over(so_far)).where("member = 0")
    earlier = held.groupBy("story_id", (F.col("bucket") + 1).alias("bucket")).agg(F.max("at").alias("before"))
    last = F.coalesce("near", "before")
    return asked.join(earlier, ["story_id", "bucket"], "left").where(last >= F.col("at") - F.expr(f"interval {int(days)} days"))


def _running_means(rows: DataFrame) -> DataFrame:
    """(article_id, story_id, running_mean): each story's rows stream by in order; the mean of a story is carried from row to row.

    A row without an article_id tells what a story begins with (n0, mean0).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        story, n, mean = None, 0, None
        for frame in frames:
            means, begun = [], frame["n0"].notna()
            for s, score, n0, mean0 in zip(frame["story_id"].tolist(), frame["score"].tolist(), frame["n0"].tolist(), frame["mean0"].tolist(), strict=True):
                if s != story:
                    story, n, mean = s, 0, None
                if pd.notna(n0):
                    n, mean = int(n0), None if pd.isna(mean0) else mean0
                else:
                    n, mean = _mean_after(n, mean, score)
                means.append(mean)
            out = pd.DataFrame({"article_id": frame["article_id"], "story_id": frame["story_id"], "running_mean": pd.array(means, dtype="Float64")})[~begun]
            yield out.astype({"article_id": "int64"})

    order = F.expr("article_id is not null")
    ordered = rows.repartition("story_id").sortWithinPartitions("story_id", order, "at", "article_id").select("article_id", "story_id", "score", "n0", "mean0")
    return ordered.mapInPandas(run, "article_id long, story_id long, running_mean double")


def assignments(articles: DataFrame, members: DataFrame, least: float = 0.5, least_shared: int = 2, days: int = 7, known: DataFrame | None = None) -> DataFrame:
    """(article_id, at, story_id) of the greedy assignment, as replay() makes it, worked out by all articles at once.

    An article's decision depends only on what earlier articles did. So a round lets every article decide by the
    stories that the last round's decisions make of the articles before it, and begins with each on its own. What the first k articles decide is
    final after k rounds at most, so where a round changes nothing, all is as in the replay; chains of decisions that change each other are short, and
    rounds few. A round is joins and aggregations: a story's nodes with the article that brought each first, an inverted index
    of nodes and stretches of ``days``, and a running maximum per story and stretch.

    ``known`` are stories (story_id, nodes, last_at) of earlier articles, which these articles may go on with, even those that are a little late.
    """
    bucket = F.floor(F.datediff(F.to_date("at"), F.lit("1970-01-01")) / days).cast("int")
    sets = next_round(_rare_first(members, articles, known is None).withColumn("bucket", bucket))
    own = sets.select("article_id", "at", "bucket", F.col("article_id").alias("story_id"))
    held, before = own, None
    if known is not None:
        kind = dict(sets.dtypes)["at"]
        lo = F.lit(sets.agg(F.min("at")).first()[0]).cast(kind)
        open_ = cut_lineage(known.where(F.col("last_at") >= lo - F.expr(f"interval {int(days)} days")))
        ago = F.struct(F.lit("0001-01-01").cast(kind).alias("at"), F.lit(-(1 << 63)).alias("article_id"))
        before = open_.select("story_id", F.explode("nodes").alias("node"), ago.alias("first"))
        # its last article, and one before all of these for those that come late
        ends = open_.select("story_id", F.explode(F.array_distinct(F.array(F.col("last_at").cast(kind), F.least(F.col("last_at").cast(kind), lo)))).alias("at"))
        ends = ends.select(F.lit(-(1 << 63)).alias("article_id"), "at", bucket.alias("bucket"), "story_id")
    while True:
        each = sets.select("article_id", "at", F.explode("nodes").alias("node")).join(held.select("article_id", "story_id"), "article_id")
        brought = each.select("story_id", "node", F.struct("at", "article_id").alias("first"))
        first = next_round((brought if before is None else brought.union(before)).groupBy("story_id", "node").agg(F.min("first").alias("first")))
        all_held = held if before is None else held.unionByName(ends)
        found = _still_open(_shared_enough(sets, first, all_held, least, least_shared, days), all_held, days)
        best = found.groupBy("article_id").agg(F.min_by("story_id", F.struct(-F.col("value"), "story_id")).alias("best"))
        now = held.join(best, "article_id", "left").select("article_id", "at", "bucket", F.coalesce("best", "article_id").alias("story_id"), (F.coalesce("best", "article_id") != F.col("story_id")).alias("changed"))
        now = next_round(now)
        held = now.drop("changed")
        if now.where("changed").isEmpty():
            return held.drop("bucket")


def _with_means(assigned: DataFrame, articles: DataFrame, known: DataFrame | None) -> DataFrame:
    scores = articles.groupBy(F.col("id").alias("article_id")).agg(F.min_by("sentiment_score", "discovered_at").alias("score"))
    rows = assigned.join(scores, "article_id").select("article_id", "at", "story_id", "score", F.lit(None).cast("long").alias("n0"), F.lit(None).cast("double").alias("mean0"))
    if known is not None:
        begun = known.join(assigned.select("story_id").distinct(), "story_id", "left_semi")
        rows = rows.unionByName(begun.select(F.lit(None).cast("long").alias("article_id"), F.col("last_at").alias("at"), "story_id", F.lit(None).cast("double").alias("score"), F.col("n").alias("n0"), F.col("mean").alias("mean0")))
    return _running_means(rows)


def story_assignment(articles: DataFrame, members: DataFrame, least: float = 0.5, least_shared: int = 2, days: int = 7) -> DataFrame:
    """(article_id, story_id, running_mean) of articles (id, discovered_at, sentiment_score) with nodes (article_id, node).

    Articles without nodes, an id or a time are in no story. Repeated members count once, and a repeated article at its
    earliest time. Empty tables give no rows.
    """
    return _with_means(assignments(articles, members, least, least_shared, days), articles, None)


def continued(articles: DataFrame, members: DataFrame, known: DataFrame, least: float = 0.5, least_shared: int = 2, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(assignment, stories) of new articles after known stories (story_id, nodes, last_at, n, mean): story_assignment() of the new ones, and the stories that they begin or change."""
    assigned = cut_lineage(assignments(articles, members, least, least_shared, days, known))
    means = cut_lineage(_with_means(assigned, articles, known))
    last = assigned.join(means.select("article_id", "running_mean"), "article_id").groupBy("story_id").agg(F.max("at").alias("at"), F.count("*").alias("more"), F.max_by("running_mean", F.struct("at", "article_id")).alias("mean"))
    brought = members.where("node is not null").join(assigned.select("article_id", "story_id"), "article_id").groupBy("story_id").agg(F.collect_set("node").alias("new"))
    old = known.select("story_id", "nodes", "last_at", "n")
    rows = last.join(brought, "story_id").join(old, "story_id", "left")
    nodes = F.array_sort(F.array_union(F.coalesce("nodes", F.array().cast("array<string>")), F.col("new")))
    return means, rows.select("story_id", nodes.alias("nodes"), F.greatest("at", "last_at").alias("last_at"), (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), "mean")


def story_recompute(story_articles: DataFrame, articles: DataFrame, members: DataFrame) -> DataFrame:
    """Count, average, span, modes (ties to the smaller name) and sorted nodes of each story."""
    rows = story_articles.join(articles.select(F.col("id").alias("article_id"), "sentiment_score", "sentiment_label", "language", "discovered_at"), "article_id")
    facts = rows.groupBy("story_id").agg(F.count("*").alias("member_count"), F.bround(F.avg("sentiment_score"), 4).alias("avg_score"), F.min("discovered_at").alias("first_seen"), F.max("discovered_at").alias("last_seen"))
    nodes = story_articles.join(members.select("article_id", "node"), "article_id").groupBy("story_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return facts.join(dominants(story_articles, articles), "story_id", "left").join(nodes, "story_id", "left")


def dominants_or_stored(stories: DataFrame, story_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """Stories (story_id, dominant_language, dominant_sentiment) with what their members have most, and what is stored where none has any."""
    found = dominants(story_articles, articles).withColumnsRenamed({"dominant_language": "language", "dominant_sentiment": "sentiment"})
    rows = stories.join(found, "story_id", "left")
    return rows.withColumns({"dominant_language": F.coalesce("language", "dominant_language"), "dominant_sentiment": F.coalesce("sentiment", "dominant_sentiment")}).drop("language", "sentiment")


def dominants(story_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """The most frequent sentiment and language of each story."""
    rows = story_articles.join(articles.select(F.col("id").alias("article_id"), "sentiment_label", "language"), "article_id")

    def most(column: str, name: str) -> DataFrame:
        counts = rows.where(F.col(column).isNotNull()).groupBy("story_id", column).agg(F.count("*").alias("c"))
        return counts.groupBy("story_id").agg(F.min_by(column, F.struct(-F.col("c"), column)).alias(name))

    return most("language", "dominant_language").join(most("sentiment_label", "dominant_sentiment"), "story_id", "full")


def longest_summary(story_articles: DataFrame, summaries: DataFrame) -> DataFrame:
    rows = story_articles.join(summaries.where("summary is not null"), "article_id")
    return rows.groupBy("story_id").agg(F.min_by("summary", F.struct(-F.length("summary"), "article_id")).alias("summary"))


def timeline(story_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """Per story and day of publication (or discovery): count, average (null without scores), counts by label."""
    rows = story_articles.join(articles.select(F.col("id").alias("article_id"), "published_at", "discovered_at", "sentiment_score", "sentiment_label"), "article_id")
    day = F.to_date(F.coalesce("published_at", "discovered_at"))
    labels = [F.count_if(F.col("sentiment_label") == x).alias(x) for x in ("pos", "neg", "neutral")]
    return rows.groupBy("story_id", day.alias("day")).agg(F.count("*").alias("n"), F.bround(F.avg("sentiment_score"), 4).alias("avg_score"), *labels)


def members_in_order(story_articles: DataFrame, articles: DataFrame, sources: DataFrame, story_id: int) -> DataFrame:
    rows = story_articles.where(F.col("story_id") == story_id).join(articles.select(F.col("id").alias("article_id"), "title", "source_id", "published_at", "discovered_at"), "article_id")
    return rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").orderBy(F.asc_nulls_last("published_at"), "discovered_at", "article_id")


def listed(stories: DataFrame, language: str | None = None, sentiment: str | None = None, nodes: list[str] | None = None, as_of: str | None = None, days: int = 0) -> DataFrame:
    """Stories by dominant language and sentiment (any case), overlap with nodes, and, if asked for, last seen within so many days."""
    out = stories
    if language:
        out = out.where(F.lower("dominant_language") == language.lower())
    if sentiment:
        out = out.where(F.lower("dominant_sentiment") == sentiment.lower())
    if nodes:
        out = out.where(F.arrays_overlap("nodes", F.array(*[F.lit(x) for x in nodes])))
    if days:
        out = out.where(F.col("last_seen") >= F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days"))
    return out


def named_node(nodes: DataFrame, name: str) -> str | None:
    """The most mentioned node whose canonical name holds a text, in any case; % and _ stand for letters as in LIKE."""
    row = nodes.where(F.col("canonical").ilike(f"%{name}%")).orderBy(F.desc("mention_count"), "node").select("node").first()
    return None if row is None else row[0]


def newest_of_node(story_articles: DataFrame, articles: DataFrame, members: DataFrame, node: str | None, limit: int = 50) -> DataFrame:
    """story_articles of the newest stories that a node is in, by the last article, then by number: all that answer() needs for them, before anything is gathered for a story."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    if node is None:
        return story_articles.limit(0)
    having = members.where(F.col("node") == node).select("article_id").distinct()
    stories = story_articles.join(having, "article_id", "left_semi").select("story_id").distinct()
    rows = story_articles.join(stories, "story_id", "left_semi").join(articles.select(F.col("id").alias("article_id"), "discovered_at"), "article_id")
    last = rows.groupBy("story_id").agg(F.max("discovered_at").alias("last_seen"))
    top = cut_lineage(last.orderBy(F.desc("last_seen"), "story_id").limit(limit).select("story_id"))
    return story_articles.join(F.broadcast(top), "story_id", "left_semi")  # at most limit rows


def answer(stories: DataFrame, story_articles: DataFrame, summaries: DataFrame, nodes: DataFrame, language: str | None = None, sentiment: str | None = None, entity: str | None = None, limit: int = 50) -> DataFrame:
    """The newest stories (1 to 200) with their first six nodes as (canonical, label) and their longest summary (article_id, summary); by an entity's name, those that its node is in."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    rows = listed(stories, language, sentiment)
    if entity:
        node = named_node(nodes, entity)
        rows = rows.limit(0) if node is None else listing_node(rows, node)
    top = cut_lineage(rows.orderBy(F.desc("last_seen"), "story_id").limit(limit))  # of stories that are answered
    each = first_nodes(top).select("story_id", F.posexplode("nodes").alias("pos", "node")).join(nodes.select("node", "canonical", "label"), "node")
    named = each.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical", "label"))).alias("entities"))
    named = named.withColumn("entities", F.transform("entities", lambda x: F.struct(x["canonical"].alias("canonical"), x["label"].alias("label"))))
    longest = longest_summary(story_articles.join(top.select("story_id"), "story_id", "left_semi"), summaries)
    return top.join(named, "story_id", "left").join(longest, "story_id", "left")


def backfill(articles: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments of all articles, and the stories recomputed from them."""
    assigned = story_assignment(articles, members)
    return assigned, story_recompute(assigned.select("story_id", "article_id"), articles, members)


def first_nodes(stories: DataFrame, most: int = 6) -> DataFrame:
    """Stories with the first few of their nodes."""
    return stories.withColumn("nodes", F.slice("nodes", 1, most))


def listing_node(stories: DataFrame, node: str) -> DataFrame:
    """Stories whose array of nodes holds one."""
    return stories.where(F.array_contains("nodes", node))


def replace_node(nodes: Column, gone: Column, canonical: Column) -> Column:
    """An array that lists a merged node: its items once each in order without that node, and the canonical one after them if it wasn't there. Others stay as they are."""
    rest = F.array_sort(F.array_distinct(F.array_remove(nodes, gone)))
    put = F.when(F.array_contains(nodes, canonical), rest).otherwise(F.concat(rest, F.array(canonical)))
    return F.when(F.array_contains(nodes, gone), put).otherwise(nodes)


def repoint(stories: DataFrame, mapping: DataFrame) -> DataFrame:
    """Node arrays with merged nodes replaced, repeats dropped, sorted."""
    each = stories.select("story_id", F.explode("nodes").alias("node")).join(mapping.toDF("node", "canonical_node"), "node", "left")
    return each.groupBy("story_id").agg(F.array_sort(F.collect_set(F.coalesce("canonical_node", "node"))).alias("nodes"))
