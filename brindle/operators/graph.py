"""Nodes, edges, triples and views of the entity graph."""

from __future__ import annotations

from itertools import count
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import normalized, placed_sentences, predicate, tells
from brindle.functions.values import ENTITY_LABELS
from brindle.operators.components import connected_components
from brindle.operators.ends import few, numbered_ends, with_labels
from brindle.session import cut_lineage, next_round


def found_mentions(articles: DataFrame, name: str) -> DataFrame:
    """Mentions of names that a pattern finds, once for each form and article; a recogniser that gives (text, label) arrays would stand here.

    The first place of a form is found in the same row as its text, so that texts are never copied to their mentions. Python
    finds it: instr goes through a text letter by letter for each of its forms, which takes far longer than all else.
    """
    label = lambda x: F.when(F.length(x) % 3 == 0, "PER").when(F.length(x) % 3 == 1, "ORG").otherwise("LOC")
    forms = F.array_distinct(F.regexp_extract_all("content", F.lit(name), F.lit(0)))

    def places(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if own is None else [text.find(x) for x in own] for text, own in zip(texts, lists, strict=True)], dtype=object)

    known = articles.select(F.col("id").alias("article_id"), "discovered_at", "content", forms.alias("text")).where(F.size("text") > 0)
    placed = F.arrays_zip("text", F.pandas_udf(places, "array<long>")("content", "text").alias("start"))
    rows = known.select("article_id", "discovered_at", placed.alias("found")).select("article_id", "discovered_at", F.explode("found").alias("m"))
    text = F.col("m.text")
    return rows.select(
        "article_id", text.alias("text"), label(text).alias("label"), F.col("m.start").alias("start"), (F.col("m.start") + F.length(text)).cast("long").alias("stop"),
        (0.5 + F.length(text) % 5 / 10.0).alias("confidence"), F.lower(text).alias("canonical"), F.concat(label(text), F.lit(":"), F.lower(text)).alias("node"), "discovered_at",
    )


def intake(predictions: DataFrame, threshold: float = 0.3, most_chars: int = 5000) -> DataFrame:
    """Mentions of a recogniser's predictions (article_id, content, text, label, start, stop, score): labels mapped (unknown ones in capitals), scores rounded.

    A recogniser reads the first ``most_chars`` characters only, so that later places can't be its own and are left out, as are
    scores below the threshold; blank contents have none. An empty canonical name or label gives no mention; repeats of (article, node, start) count once.
    """
    known = F.create_map(*[F.lit(x) for pair in ENTITY_LABELS.items() for x in pair])
    label = F.coalesce(known[F.lower("label")], F.upper("label"), F.lit("MISC"))
    canonical = normalized(F.col("text"))
    rows = predictions.where((F.col("score") >= threshold) & (F.col("stop") <= most_chars) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    rows = rows.select("article_id", "text", label.alias("label"), "start", "stop", F.bround("score", 4).alias("confidence"), canonical.alias("canonical"))
    return rows.where("canonical <> ''").withColumn("node", F.concat("label", F.lit(":"), "canonical")).dropDuplicates(["article_id", "node", "start"])


def with_keys(entities: str, name: str = "text") -> Column:
    """An array of structs, each with the normalised form of its name as ``normalized``."""
    return F.transform(entities, lambda e: e.withField("normalized", normalized(e[name])))


def wiki_url(qid: Column) -> Column:
    """The page of a knowledge-base id; null without one."""
    return F.when(qid.isNotNull() & (qid != ""), F.concat(F.lit("https://www.wikidata.org/wiki/"), qid))


def top_labels(nodes: DataFrame, most: int = 22) -> DataFrame:
    """The heaviest nodes, whose names a drawing shows."""
    return nodes.orderBy(F.desc("mention_count"), "node").limit(most).select("node", "canonical", "mention_count")


def forms(mentions: DataFrame) -> DataFrame:
    """(node, canonical, label, text, n, a, z): each form of a node's name with its mentions, and when it was seen first and last."""
    named = mentions.where("canonical <> ''")
    return named.groupBy("node", "canonical", "label", "text").agg(F.count("*").alias("n"), F.min("discovered_at").alias("a"), F.max("discovered_at").alias("z"))


def nodes_of(each: DataFrame) -> DataFrame:
    """One node per canonical name and label of some forms: aliases (first seen first), mention_count, first_seen, last_seen."""
    aliases = F.transform(F.array_sort(F.collect_list(F.struct("a", "text"))), lambda x: x["text"])
    return each.groupBy("node", "canonical", "label").agg(aliases.alias("aliases"), F.sum("n").alias("mention_count"), F.min("a").alias("first_seen"), F.max("z").alias("last_seen"))


def resolve_nodes(mentions: DataFrame) -> DataFrame:
    """The nodes of some mentions."""
    return nodes_of(forms(mentions))


#: Nodes of an article that meet others in one row, and pairs of nodes that a task counts.
NODES, PAIRS = 256, 1_000_000


def cooccurrence_edges(mentions: DataFrame, key: str = "article_id") -> DataFrame:
    """(a, b, weight): pairs of nodes a < b and the number of articles that have both.

    An article's nodes are ordered from rare to common, and each node is sent the list of those after it, so that a pair is counted
    where its rarer node is: a shuffled row holds many pairs, and a common node gets few lists. The lists are dealt to so many tasks
    that each counts about PAIRS pairs. An article of many nodes is cut into blocks of NODES; every pair of
    blocks is a row of its own, so that no task makes all pairs of a long article.
    """
    each = next_round(mentions.select(key, "node").where(F.col(key).isNotNull() & F.col("node").isNotNull()).distinct())  # read twice; the texts behind it once
    common = each.groupBy("node").agg(F.count("*").alias("f"))
    rare_first = F.transform(F.array_sort(F.collect_list(F.struct("f", "node"))), lambda x: x["node"])
    sets = next_round(each.join(common, "node").groupBy(key).agg(rare_first.alias("nodes")).select("nodes", F.size("nodes").alias("n")).where("n > 1"))
    made, most = sets.agg(F.sum(F.col("n").cast("long") * (F.col("n") - 1) / 2), F.max("n")).first()

    after = F.slice("nodes", F.col("i") + 2, F.col("n"))
    lists = sets.where(F.col("n") <= NODES).select("nodes", "n", F.posexplode("nodes").alias("i", "own")).where("i < n - 1").select("own", after.alias("others"))
    if (most or 0) > NODES:
        last = F.ceil(F.col("n") / NODES).cast("int") - 1
        cut = sets.where(F.col("n") > NODES).select("nodes", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("x"))
        cut = cut.select("nodes", "x", F.explode(F.sequence("x", "last")).alias("y"))
        block = lambda c: F.slice("nodes", F.col(c) * NODES + 1, F.lit(NODES))
        cut = cut.select("x", "y", block("x").alias("xs"), block("y").alias("nodes")).repartition(ceil(made / PAIRS), F.xxhash64("xs"), "x", "y")
        spread = cut.select("x", "y", "nodes", F.size("nodes").alias("n"), F.posexplode("xs").alias("i", "own"))
        lists = lists.union(spread.select("own", F.when(F.col("x") == F.col("y"), after).otherwise(F.col("nodes")).alias("others")))
    dealt = lists.repartition(ceil((made or 0) / PAIRS) or 1, "own").select("own", F.explode("others").alias("other"))
    weights = dealt.groupBy("own", "other").agg(F.count("*").alias("weight"))
    return weights.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "weight")


def relationship_triples(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """(subject, object, predicate, article_id, confidence) from phrases between mentions of one sentence.

    A repeated sentence is placed where it stands first, as a search for its text finds it.
    Of equal triples in an article the one of the earliest pair stays. Sentences are placed while a text is split, each
    goes to its mentions by itself, and whole texts are never shuffled. What lies between two mentions has a phrase only if
    their sentence has it, so that texts and sentences without any are left out first.
    """
    said = articles.where(tells(F.col("content")))
    s = said.select(F.col("id").alias("article_id"), F.explode(placed_sentences(F.col("content"))).alias("s")).select("article_id", F.col("s.start").alias("s0"), F.col("s.text").alias("sentence"))
    s = s.where(tells(F.col("sentence")))
    s = s.groupBy("article_id", "sentence").agg(F.min("s0").alias("s0"))  # a repeated sentence stands at its first place
    m = mentions.select("article_id", "node", "start", "stop", "confidence")
    inside = m.join(s.select("article_id", "s0", "sentence", F.length("sentence").alias("n")), "article_id").where("start >= s0 and start < s0 + n")
    a = inside.select("article_id", "s0", "sentence", F.col("node").alias("subject"), F.col("start").alias("a0"), F.col("stop").alias("a1"), F.col("confidence").alias("ca"))
    b = inside.select("article_id", "s0", F.col("node").alias("object"), F.col("start").alias("b0"), F.col("confidence").alias("cb"))
    pairs = a.join(b, ["article_id", "s0"]).where("b0 >= a1")
    between = F.substring(F.col("sentence"), (F.col("a1") - F.col("s0")).cast("int") + 1, (F.col("b0") - F.col("a1")).cast("int"))
    found = pairs.select("article_id", "s0", "a0", "b0", "subject", "object", "ca", "cb", predicate(between).alias("predicate")).where("predicate is not null")
    confidence = F.bround(F.least("ca", "cb", F.lit(1.0)) * 0.8, 3)
    return found.groupBy("subject", "object", "predicate", "article_id").agg(F.min_by(confidence, F.struct("s0", "a0", "b0")).alias("confidence"))


def neighbour_triples(mentions: DataFrame) -> DataFrame:
    """Triples between names that follow each other in an article; the predicate stands for how far apart they are."""
    from pyspark.sql import Window

    order = Window.partitionBy("article_id").orderBy("start", "text")
    near = mentions.withColumns({"object": F.lead("node").over(order), "next": F.lead("start").over(order), "cb": F.lead("confidence").over(order)})
    gap = F.col("next") - F.col("stop")
    name = F.when(gap < 20, "stated").when(gap < 80, "met_with").otherwise("located_in")
    rows = near.where("object is not null").select(F.col("node").alias("subject"), "object", name.alias("predicate"), "article_id", F.bround(F.least("confidence", "cb") * 0.8, 3).alias("confidence"))
    return rows.groupBy("subject", "object", "predicate", "article_id").agg(F.max("confidence").alias("confidence"))


def with_ends(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges with names and labels of both ends."""
    side = lambda c, p: nodes.select(F.col("node").alias(c), F.col("canonical").alias(f"{p}_text"), F.col("label").alias(f"{p}_label"))
    return edges.join(side(a, "a"), a).join(side(b, "b"), b)


def touching(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    return with_ends(edges, nodes).where((F.col("a_label") == label) | (F.col("b_label") == label))


def touching_label(edges: DataFrame, label: str) -> DataFrame:
    """touching() of edges between nodes of found_mentions() or intake(): such a node is called by its label, which has no colon, a colon and its canonical name.

    So nothing is joined: edges aren't shuffled for either end, and no nodes are broadcast, which would pass through the driver.
    """
    text = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    ends = [x for c in "ab" for x in (text(c).alias(f"{c}_text"), F.substring_index(c, ":", 1).alias(f"{c}_label"))]
    named = edges.select("b", "a", "weight", *ends).where("a_text <> '' and b_text <> ''")  # as nodes without a name are none
    return named.where((F.col("a_label") == label) | (F.col("b_label") == label))


def induced_topn(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Edges within the n nodes of most mentions (ties by name); 0 means all."""
    if not n:
        return edges
    top = nodes.orderBy(F.desc("mention_count"), "node").limit(n).select("node")
    return edges.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")


def ego_edges(edges: DataFrame, nodes: DataFrame, node: str, k: int = 15) -> DataFrame:
    """The heaviest edges of a node with its other end."""
    own = edges.where((F.col("a") == node) | (F.col("b") == node)).withColumn("other", F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")))
    top = own.orderBy(F.desc("weight"), "other").limit(k).select("other", "weight")
    return top.join(nodes.select(F.col("node").alias("other"), "canonical", "label"), "other")


def graph_stats(nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> DataFrame:
    """(kind, name, n): totals, mentions by label, triples by predicate."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    labels = nodes.groupBy("label").agg(F.sum("mention_count").alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    predicates = triples.groupBy("predicate").agg(F.count("*").alias("n")).select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"), "n")
    return total(nodes, "nodes").union(total(edges, "edges")).union(total(triples, "triples")).union(labels).union(predicates)


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"), F.count("*").alias("neighbours"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The nodes one edge away, and the node itself."""
    own = edges.where((F.col("a") == node) | (F.col("b") == node))
    return own.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def entity_articles(articles: DataFrame, mentions: DataFrame, sources: DataFrame, node: str) -> DataFrame:
    """Articles of a node, once per mention."""
    own = mentions.where(F.col("node") == node).select(F.col("article_id").alias("id"), "text")
    return own.join(articles.select("id", "title", "source_id", "discovered_at"), "id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")


def dossier_stats(articles: DataFrame, mentions: DataFrame, node: str) -> DataFrame:
    own = mentions.where(F.col("node") == node).select(F.col("article_id").alias("id")).join(articles.select("id", "discovered_at"), "id")
    return own.agg(F.count("id").alias("mentions"), F.min("discovered_at").alias("first_seen"), F.max("discovered_at").alias("last_seen"))


def dossier_distributions(articles: DataFrame, mentions: DataFrame, node: str) -> DataFrame:
    """(kind, name, n) by sentiment and by language, from one pass."""
    own = mentions.where(F.col("node") == node).select(F.col("article_id").alias("id")).join(articles.select("id", "sentiment_label", "language"), "id")
    pairs = own.groupBy("sentiment_label", "language").agg(F.count("*").alias("n"))
    kinds = F.explode(F.array(F.struct(F.lit("sentiment").alias("kind"), F.col("sentiment_label").alias("name")), F.struct(F.lit("language").alias("kind"), F.col("language").alias("name"))))
    return pairs.select(kinds.alias("k"), "n").groupBy("k.kind", "k.name").agg(F.sum("n").alias("n"))


#: Rounds of label propagation in which all nodes have had their turn, before only nodes without a moving neighbour move.
TURNS = 15


def propagated(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, community) by label propagation: each node takes the label of most weight around it, ties to the smaller.

    A node keeps its own label as one vote. Nodes take turns by a hash that differs from turn to turn, so that neighbours seldom
    swap labels again and again. Where that doesn't settle in TURNS rounds, of neighbours that want to move only one does, by a
    hash: each such move adds one at least to the weight within communities, so that it always ends, when no label changes.
    Raises RuntimeError if a limit is given and that takes more rounds. Cheaper and coarser than communities.communities(),
    which raises modularity.
    """
    both, names = numbered_ends(edges.select("a", "b", F.col("weight").alias("w")))
    labels = names.select("node", F.col("node").alias("community"))
    still, small = 0, few(names)
    for round_ in count() if most_rounds is None else range(2 * most_rounds):
        careful = round_ >= 2 * TURNS
        # only those whose turn it is ask; their votes are added up where their edges lie
        turn = lambda c: F.lit(True) if careful else F.pmod(F.xxhash64(c, F.lit(round_ // 2)), F.lit(2)) == round_ % 2  # noqa: E731, B023
        asked = with_labels(both.where(turn("x")), labels.select(F.col("node").alias("y"), "community"), "y", small)
        votes = asked.groupBy(F.col("x").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = labels.toDF("node", "own").where(turn("node"))
        best = F.min_by("community", F.struct(-(F.col("w") + F.when(F.col("community") == F.col("own"), 1).otherwise(0)), "community"))
        there = with_labels(votes, own, "node", small).groupBy("node").agg(best.alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("w"))).alias("w_own"), F.max("w").alias("most"))
        new = labels.join(there, "node", "left")
        # its own label has one vote, also where no neighbour has it
        lone = F.col("w_own").isNull() & ((F.col("most") < 1) | ((F.col("most") == 1) & (F.col("community") < F.col("best"))))
        best = F.when(lone, F.col("community")).otherwise(F.coalesce("best", "community"))
        new = next_round(new.select("node", "community", best.alias("best"), (best != F.col("community")).alias("moved")))
        settled = new.where("moved").isEmpty()
        still = still + 1 if settled else 0
        if still == 2 or (careful and settled):
            return labels.join(names, "node").select(F.col("name").alias("node"), "community").join(names.toDF("community", "least"), "community").select("node", F.col("least").alias("community"))
        if careful:
            new = next_round(_one_of_neighbours(both, new, round_, small))
        labels = new.select("node", F.when(F.col("moved"), F.col("best")).otherwise(F.col("community")).alias("community"))
    raise RuntimeError(f"communities didn't settle in {most_rounds} rounds")


def _one_of_neighbours(both: DataFrame, new: DataFrame, round_: int, small: bool) -> DataFrame:
    """The nodes, with ``moved`` left only where no neighbour that would move comes first by a hash."""
    place = lambda c: F.struct(F.xxhash64(c, F.lit(round_)), F.col(c))
    movers = new.where("moved").select("node")
    near = with_labels(both.where("x <> y").select("x", "y"), movers.toDF("y"), "y", small).groupBy(F.col("x").alias("node")).agg(F.min(place("y")).alias("first"))
    return new.join(near, "node", "left").select("node", "community", "best", (F.col("moved") & (F.col("first").isNull() | (place("node") < F.col("first")))).alias("moved"))


def modularity(edges: DataFrame, members: DataFrame, by: str = "community") -> DataFrame:
    """One row: the modularity of a partition of the nodes; null without edges."""
    ends = edges.select(F.col("a").alias("node"), F.col("weight").alias("w")).union(edges.select("b", "weight"))
    degree = ends.join(members, "node").groupBy(by).agg(F.sum("w").cast("double").alias("degree"))
    a, b = (members.select(F.col("node").alias(x), F.col(by).alias(f"{x}_in")) for x in "ab")
    inner = edges.join(a, "a").join(b, "b").groupBy(F.col("a_in").alias(by)).agg(F.sum(F.when(F.col("a_in") == F.col("b_in"), F.col("weight")).otherwise(0)).cast("double").alias("inner"))
    rows = degree.join(inner, by, "left")
    total = F.sum("degree")
    return rows.agg(F.when(total > 0, F.sum(2 * F.coalesce("inner", F.lit(0.0))) / total - F.sum(F.col("degree") * F.col("degree")) / (total * total)).alias("modularity"))


def cluster_summary(members: DataFrame, nodes: DataFrame, by: str = "community") -> DataFrame:
    """Size and heaviest node of each cluster, the largest first."""
    rows = members.join(nodes.select("node", "mention_count"), "node")
    sums = rows.groupBy(by).agg(F.count("*").alias("size"), F.min_by("node", F.struct(-F.col("mention_count"), "node")).alias("heaviest"))
    return sums.orderBy(F.desc("size"), by)


def edge_components(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "a", "b")
