"""Merging nodes: by similar names and by knowledge-base ids."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import base_form, normalized
from brindle.functions.values import TYPE_HINTS
from brindle.functions.vectors import entity_similarity, matching_ratios
from brindle.operators.components import connected_components
from brindle.session import next_round


#: How far apart the lengths of similar names are, and the letters of a gram: of two names that are long enough, and of others.
APART, LONG_GRAM, GRAM = 2, 3, 2
#: Ways to leave letters out of a name beyond which names of its length meet by grams, and the greatest length that is tried.
WAYS, LONGEST = 2000, 64
#: Names that a task lists, and candidates whose similarity a task works out.
NAMES, PAIRS = 10_000, 50_000
#: Names of a block, all pairs of two of which are one row, and pairs of names in a task that compares blocks.
BLOCK, BLOCK_PAIRS = 256, 1_000_000


def _need(n: int, other: int, least: float, q: int) -> int | None:
    """How many grams of q letters two names of these lengths share at least if their ratio reaches ``least``; None if it can't.

    The ratio is twice the letters in matching blocks over both lengths. A letter of the one that isn't matched breaks
    q of its grams, and one of the other breaks q - 1.
    """
    matched = ceil((n + other) * least / 2 - 1e-9)
    return n - q + 1 - q * (n - matched) - (q - 1) * (other - matched) if matched <= min(n, other) else None


def _long_from(least: float, most: int = 400) -> int:
    """The length from which names of at least that length always share a long gram."""
    met = [n for n in range(1, most) if any((x := _need(n, n + d, least, LONG_GRAM)) is not None and x < 1 for d in range(-APART, APART + 1) if n + d > 0)]
    return max(met, default=0) + APART + 1


def _matched(n: int, other: int, least: float) -> int:
    """Letters in matching blocks that two names of these lengths have at least if their ratio reaches ``least``."""
    return ceil((n + other) * least / 2 - 1e-9)


def _short_to(least: float) -> int:
    """The greatest length up to which names have WAYS or fewer ways to keep the letters that match in one of a near length."""
    for n in range(1, LONGEST + 1):
        if any(comb(n, m) > WAYS for o in range(max(n - APART, 1), n + APART + 1) if (m := _matched(n, o, least)) <= min(n, o)):
            return n - 1
    return LONGEST


def _by_kept_letters(names: DataFrame, least: float) -> DataFrame:
    """(a, b, ca, cb) of names (node, canonical, label, first, len) that have as many letters in common, in their order, as matching blocks would need.

    Each name is listed under what is left of it when the letters that needn't match are left out, once for each length that a name of
    its label and first letter has. The names of a key all have those letters in common, so that hardly more pairs are made than are similar.
    """
    lengths = names.select("label", "first", F.col("len").alias("other")).distinct()
    near = lengths.withColumn("len", F.explode(F.sequence(F.col("other") - APART, F.col("other") + APART)))
    asked = names.join(F.broadcast(near.groupBy("label", "first", "len").agg(F.collect_set("other").alias("others"))), ["label", "first", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for *own, size, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for o in others:
                    if (m := _matched(size, o, least)) <= min(size, o):
                        rows += [(*own, size, o, k) for k in {"".join(c) for c in combinations(own[1], m)}]
                if len(rows) > PAIRS:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([(c, pa.string()) for c in ("node", "canonical", "label", "first")] + [("len", pa.int32()), ("other", pa.int32()), ("kept", pa.string())])
    asked = asked.select("node", "canonical", "label", "first", "len", "others").repartition(ceil(names.count() / NAMES) or 1, "node")
    each = asked.mapInArrow(run, "node string, canonical string, label string, first string, len int, other int, kept string")
    key = F.xxhash64("label", "first", F.least("len", "other"), F.greatest("len", "other"), "kept").alias("key")
    each = next_round(each.select("node", "canonical", "label", "first", "len", "other", key))
    side = lambda p, l, o: each.select(F.col("node").alias(p), F.col("canonical").alias(f"c{p}"), F.col("len").alias(l), F.col("other").alias(o), "key", "label", "first")
    return side("a", "la", "lb").join(side("b", "lb", "la"), ["key", "label", "first", "la", "lb"]).where("a < b").select("a", "b", "ca", "cb").distinct()


def _shared_grams(n: Column, other: Column, least: float, q: int) -> Column:
    """_need() of columns."""
    matched = F.ceil((n + other) * least / 2 - 1e-9)
    return F.when(matched <= F.least(n, other), n - q + 1 - q * (n - matched) - (q - 1) * (other - matched))


def _grams(name: Column, q: int) -> Column:
    """Grams of a name with their places; a repeated one counts its occurrences."""
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - q + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring(name, i, F.lit(q)).alias("g")))
    return F.transform(letters, lambda x: F.struct(F.concat(x["g"], F.lit("#"), F.size(F.filter(F.slice(letters, F.lit(1), x["at"]), lambda y: y["g"] == x["g"]))).alias("gram"), x["at"].alias("at")))


def _near_lengths(df: DataFrame) -> DataFrame:
    return df.withColumn("len2", F.explode(F.sequence(F.col("len") - APART, F.col("len") + APART)))


def _by_gram(names: DataFrame, least: float, q: int, fits: Column) -> DataFrame:
    """(a, b, ca, cb) of names (node, canonical, label, first, len) that share a rare gram near the same place, and enough grams of all; ``fits`` says of lengths la and lb which pairs are asked for."""
    n = F.col("len")
    needs = [_shared_grams(n, n + d, least, q) for d in range(-APART, APART + 1)]
    each = names.select("*", F.explode(_grams(F.col("canonical"), q)).alias("x")).select("node", "canonical", "label", "first", "len", "x.gram", "x.at")
    common = each.groupBy("label", "first", "gram").agg(F.count("*").alias("f"))
    listed = each.join(common, ["label", "first", "gram"]).groupBy("node", "canonical", "label", "first", "len").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "at"))).alias("x"))
    # a need of none is met by what the caller does with short names, so one gram is asked for here
    rare = listed.withColumn("need", F.greatest(F.least(*needs), F.lit(1))).where("need is not null")
    rare = rare.select("node", "canonical", "label", "first", "len", F.explode(F.slice("x", F.lit(1), F.greatest(F.size("x") - F.col("need") + 1, F.lit(1)).cast("int"))).alias("y"))
    rare = rare.select("node", "canonical", "label", "first", "len", "y.gram", "y.at")
    one = rare.toDF("a", "ca", "label", "first", "la", "gram", "ata")
    two = _near_lengths(rare).select(F.col("node").alias("b"), F.col("canonical").alias("cb"), "label", "first", F.col("len").alias("lb"), "gram", F.col("at").alias("atb"), F.col("len2").alias("la"))
    la, lb = F.col("la"), F.col("lb")
    bag = lambda c: F.transform(_grams(F.col(c), q), lambda x: x["gram"])
    enough = F.size(F.array_intersect(bag("ca"), bag("cb"))) >= F.greatest(_shared_grams(la, lb, least, q), _shared_grams(lb, la, least, q))
    loose = la + lb - 2 * F.ceil((la + lb) * least / 2 - 1e-9)  # letters that aren't matched
    met = one.join(two, ["label", "first", "gram", "la"]).where((F.col("a") < F.col("b")) & fits & (F.abs(F.col("ata") - F.col("atb")) <= loose))
    return met.where(enough).select("a", "b", "ca", "cb")


def candidate_pairs(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, ca, cb) with a < b: nodes of one label and first letter, lengths at most APART apart, that may be similar, each pair once.

    Names meet by the letters that they have in common. Names so long that there are too many ways to leave letters out
    meet by an inverted index of grams: similar names share so many that one of the rarest of each is among them, and near the same
    place; a hot one is split like any skewed join key, and pairs that meet must share enough grams of all. Names
    whose base is the other's base or the other itself meet by that.
    """
    kept = nodes.where("canonical <> ''").select("node", "canonical", "label", F.substring("canonical", 1, 1).alias("first"), F.length("canonical").alias("len"))
    kept = next_round(kept)
    n, both, either = F.col("len"), F.least("la", "lb"), F.greatest("la", "lb")
    short, long = _short_to(least), _long_from(least)
    found = _by_kept_letters(kept.where(n <= short), least)
    more = kept.where(n > short - APART)
    if not kept.where(n > short).isEmpty():
        far = either > short
        found = found.union(_by_gram(more.where(n >= long), least, LONG_GRAM, far & (both >= long))).union(_by_gram(more.where(n < long + APART), least, GRAM, far & (both < long)))
        # lengths of which one may share no gram with the other
        needs = [_shared_grams(n, n + d, least, GRAM) for d in range(-APART, APART + 1)]
        gramless = more.withColumn("need", F.least(*needs)).where((F.col("need") <= 0) & (n < long + APART)).drop("need")
        others = _near_lengths(more).select(F.col("node").alias("b"), F.col("canonical").alias("cb"), "label", "first", F.col("len").alias("lb"), F.col("len2").alias("la"))
        met = gramless.toDF("a", "ca", "label", "first", "la").join(others, ["label", "first", "la"]).where((F.col("a") != F.col("b")) & far)
        found = found.union(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(F.col("a") < F.col("b"), F.col("cb")).otherwise(F.col("ca")).alias("cb")))
    based = kept.withColumn("key", F.explode(F.array_distinct(F.array("canonical", base_form(F.col("canonical")))))).where("key <> ''")
    bases = based.toDF("a", "ca", "label", "first", "la", "key").join(based.toDF("b", "cb", "label", "first", "lb", "key"), ["label", "first", "key"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= APART))
    return found.union(bases.select("a", "b", "ca", "cb")).distinct()


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs of names in parts of about PAIRS, written once: they are few bytes, which would be put together in few tasks, and much work."""
    pairs = next_round(pairs)
    return pairs.repartition(ceil(pairs.count() / PAIRS) or 1)


def similar_pairs(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) with a < b: same label and first letter, lengths at most 2 apart, similar names; the ratio of candidates is worked out through Arrow."""
    pairs = spread(candidate_pairs(nodes, least)).withColumn("similarity", entity_similarity("ca", "cb", least))
    return pairs.where(F.col("similarity") >= least).select("a", "b", F.bround("similarity", 4).alias("similarity"))


def scores_within(names: DataFrame) -> DataFrame:
    """(label, a, b, similarity) of all pairs a < b of different names (label, key, canonical) of a label and key; nulls are in none.

    Names of a key are cut into blocks of BLOCK, and every pair of blocks is a row, so that no pair is a row before its
    similarity is known, and a large key is spread over tasks of about BLOCK_PAIRS pairs. It equals entity_similarity().
    """
    each = names.where("label is not null and key is not null and canonical is not null").select("label", "key", "canonical", base_form(F.col("canonical")).alias("base")).distinct()
    each = next_round(each)
    counts = each.groupBy("label", "key").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    cut = each.join(counts, ["label", "key"]).withColumn("block", F.pmod(F.xxhash64("canonical"), "blocks"))
    lists = next_round(cut.groupBy("label", "key", "block").agg(F.collect_list(F.struct("canonical", "base")).alias("own")).select("label", "key", "block", F.col("own.canonical").alias("names"), F.col("own.base").alias("bases")))
    other = lists.select("label", "key", F.col("block").alias("to"), F.col("names").alias("others"), F.col("bases").alias("other_bases"))
    none = F.array().cast("array<string>")
    rows = lists.join(other, ["label", "key"]).where("block <= to").withColumns({c: F.when(F.col("block") < F.col("to"), F.col(c)).otherwise(none) for c in ("others", "other_bases")})
    pairs = counts.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    dealt = rows.repartition(ceil(pairs / BLOCK_PAIRS) or 1, "label", "key", "block", "to")
    return dealt.select("label", "names", "bases", "others", "other_bases").mapInArrow(_scored_blocks, "label string, a string, b string, similarity double")


def _scored_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of names of a row, or of its names and others, where it has others."""

    def scored(names: list[str], bases: list[str], labels: list[str], parts: list[tuple]) -> pa.RecordBatch:
        of, i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        number = {x: n for n, x in enumerate(sorted({*names, *bases}))}  # in the order of names
        own, base = (np.array([number[x] for x in xs], np.int64) for xs in (names, bases))
        some = np.array([x != "" for x in bases])
        swapped = own[i] > own[j]
        i, j = np.where(swapped, j, i), np.where(swapped, i, j)
        alike = some[i] & (base[i] == base[j])
        near = some[i] & ((base[i] == own[j]) | (base[j] == own[i]))
        value = np.where(alike, 1.0, 0.95)
        rest = np.flatnonzero(~(alike | near))
        value[rest] = matching_ratios(names, i[rest], j[rest])
        text = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()).take(pa.array(of)), text.take(pa.array(i)), text.take(pa.array(j)), pa.array(value)], ["label", "a", "b", "similarity"])

    names, bases, labels, parts, n = [], [], [], [], 0
    for batch in batches:
        for x in range(batch.num_rows):
            label, own, own_bases, others, other_bases = (c[0].as_py() for c in batch.slice(x, 1).columns)
            at, m = len(names), len(own)
            i, j = np.triu_indices(m, 1) if not others else (c.ravel() for c in np.meshgrid(np.arange(m), m + np.arange(len(others)), indexing="ij"))
            parts.append((np.full(len(i), len(labels)), at + i, at + j))
            labels.append(label)
            names += own + others
            bases += own_bases + other_bases
            n += len(i)
            if n >= PAIRS:
                yield scored(names, bases, labels, parts)
                names, bases, labels, parts, n = [], [], [], [], 0
    if n:
        yield scored(names, bases, labels, parts)


def clusters(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, canonical_node): each merged node with its cluster's most mentioned one (then the shorter, then the smaller)."""
    comp = connected_components(pairs, "a", "b").join(nodes.select("node", "canonical", "mention_count"), "node")
    best = comp.groupBy("component").agg(F.min_by("node", F.struct(-F.col("mention_count"), F.length("canonical"), "node")).alias("canonical_node"))
    return comp.join(best, "component").where("node <> canonical_node").select("node", "canonical_node")


def qid_mapping(nodes: DataFrame, by_label: bool = False) -> DataFrame:
    """The same for nodes that share a knowledge-base id (and, if asked for, a label)."""
    keys = ["wikidata_id", "label"] if by_label else ["wikidata_id"]
    linked = nodes.where("wikidata_id is not null")
    best = linked.groupBy(*keys).agg(F.min_by("node", F.struct(-F.col("mention_count"), "node")).alias("canonical_node"), F.count("*").alias("n")).where("n > 1")
    return linked.join(best, keys).where("node <> canonical_node").select("node", "canonical_node")


def mapped(df: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    out = df
    for c in columns:
        m = mapping.select(F.col("node").alias(c), F.col("canonical_node").alias("__to"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return out


def merge_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts summed, aliases united and sorted, the canonical's name kept."""
    m = mapped(nodes.withColumn("__own", F.col("node")), mapping, "node")
    own = m.where("node = __own").select("node", "canonical", "label")
    sums = m.groupBy("node").agg(F.sum("mention_count").alias("mention_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    return own.join(sums, "node")


def merge_edges(edges: DataFrame, mapping: DataFrame, combine: str = "sum") -> DataFrame:
    """Edges between canonical nodes; loops go, weights of edges that fall together are summed or the largest is kept."""
    m = mapped(edges, mapping, "a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    how = {"sum": F.sum, "max": F.max}[combine]
    return m.groupBy("a", "b").agg(how("weight").alias("weight"))


def merge_triples(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples between canonical nodes, equal ones once, with the greatest confidence."""
    return mapped(triples, mapping, "subject", "object").groupBy("subject", "object", "predicate", "article_id").agg(F.max("confidence").alias("confidence"))


def merge_mentions(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    return mapped(mentions, mapping, "node")


def merge_apply(mapping: DataFrame, nodes: DataFrame, edges: DataFrame, triples: DataFrame, mentions: DataFrame, combine: str = "sum", repoint: tuple[str, ...] = ("mentions", "triples")) -> dict[str, DataFrame]:
    """All tables after a merge. Tables that aren't repointed lose what refers to merged nodes (triples) or keep it without a node (mentions)."""
    gone = mapping.select("node")
    kept = triples.join(gone.withColumnRenamed("node", "subject"), "subject", "left_anti").join(gone.withColumnRenamed("node", "object"), "object", "left_anti")
    lost = mentions.join(gone.withColumn("__gone", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("__gone"), None).otherwise(F.col("node"))).drop("__gone")
    return {
        "nodes": merge_nodes(nodes, mapping),
        "edges": merge_edges(edges, mapping, combine),
        "triples": merge_triples(triples, mapping) if "triples" in repoint else kept,
        "mentions": merge_mentions(mentions, mapping) if "mentions" in repoint else lost,
    }


def link_candidates(nodes: DataFrame, least_mentions: int = 3, most: int = 200) -> DataFrame:
    """Nodes without an id that are worth a look-up, the most mentioned first."""
    return nodes.where(F.col("wikidata_id").isNull() & (F.col("mention_count") >= least_mentions)).orderBy(F.desc("mention_count"), "node").limit(most)


def disambiguate(candidates: DataFrame, least: float = 1.5) -> DataFrame:
    """The best candidate of each node: (node, qid, score), if it scores enough.

    candidates: node, canonical, label, qid, name, description, aliases, place (the
    order in which they were found; the first of equals wins).
    """
    name = normalized(F.col("name"))
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: normalized(a) == F.col("canonical"))
    part = (F.col("canonical") != "") & (F.contains("canonical", name) | F.contains(name, F.col("canonical")))
    hint = F.lit(False)
    for label, words in TYPE_HINTS.items():
        hint = hint | ((F.col("label") == label) & F.lower(F.coalesce("description", F.lit(""))).rlike("|".join(words)))
    points = lambda when, x: F.when(when, x).otherwise(0.0)
    scored = candidates.withColumn("score", points(name == F.col("canonical"), 2.0) + points(alias, 1.5) + points(part, 0.5) + points(hint, 0.5))
    best = scored.groupBy("node").agg(F.min_by(F.struct("qid", "score"), F.struct(-F.col("score"), "place")).alias("b"))
    return best.select("node", "b.qid", "b.score").where(F.col("score") >= least)
