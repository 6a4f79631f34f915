"""The gram index against all pairs of a block, and merges over its clusters."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brindle.functions.text import base_form
from brindle.operators import merge
from brindle.plans.registry import QUERIES

NODES = "node string, canonical string, label string, mention_count long, aliases array<string>"


def names(seed, n):
    r = random.Random(seed)
    roots = ["".join(r.choices("abcde", k=r.randint(1, 12))) for _ in range(12)]
    out = set()
    while len(out) < n:
        x = list(r.choice(roots))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(x) + 1)
            x[i : i + r.randint(0, 1)] = r.choices("abcdeo", k=r.randint(0, 1))
        out.add("".join(x) + r.choice(["", "", "", "ot", "ta", "s"]))
    return sorted(out - {""})


def similarity(bases, a, b):
    if a == b or bases[a] and bases[a] == bases[b]:
        return 1.0
    if bases[a] and (bases[a] == b or bases[b] == a):
        return 0.95
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize(("seed", "least"), [(1, 0.8), (2, 0.9), (3, 0.55)])
def test_pairs_are_those_of_all_pairs(spark, seed, least):
    rows = [(f"{lab}:{x}", x, lab, len(x), [x]) for x in names(seed, 150) for lab in ("PER", "LOC")[: 1 + len(x) % 2]]
    nodes = spark.createDataFrame([*rows, ("PER:", "", "PER", 1, [])], NODES).repartition(3)
    bases = {r.c: r.b for r in nodes.select(F.col("canonical").alias("c"), base_form(F.col("canonical")).alias("b")).collect()}
    want = {}
    for a, ca, la, *_ in rows:
        for b, cb, lb, *_ in rows:
            if a < b and la == lb and ca[0] == cb[0] and abs(len(ca) - len(cb)) <= 2 and (v := similarity(bases, ca, cb)) >= least:
                want[a, b] = v
    got = {(r.a, r.b): r.similarity for r in merge.similar_pairs(nodes, least).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want) and len(want) > 5


def test_names_of_one_letter_and_length_meet_few(spark):
    """Blocks of letter and length would pair all with all, and grams pair those that share rare ones."""
    n = 5_000
    rows = spark.range(n).select(F.concat(F.lit("a"), F.substring(F.md5(F.col("id").cast("string")), 1, 11)).alias("canonical"))
    nodes = rows.select(F.concat(F.lit("PER:"), "canonical").alias("node"), "canonical", F.lit("PER").alias("label"))
    assert merge.candidate_pairs(nodes, 0.9).count() < n


def test_lower_ratios_meet_few_too(spark):
    """At 0.8 names of ten letters share so few grams that those pair thousands that aren't similar."""
    n = 5_000
    rows = spark.range(n).select(F.concat(F.lit("a"), F.substring(F.md5(F.col("id").cast("string")), 1, 9)).alias("canonical"))
    nodes = rows.select(F.concat(F.lit("PER:"), "canonical").alias("node"), "canonical", F.lit("PER").alias("label"))
    assert merge.candidate_pairs(nodes, 0.8).count() < n / 5


def test_long_names_and_longer_ones_meet(spark):
    """Names on both sides of the length up to which ways to leave letters out are few."""
    n = merge._short_to(0.8)
    x = "abcdefghijklmnopqrstuvwxyz"[:n]
    rows = [(y, y, "PER") for y in (x, x[:-2], x + "z", x + "zy", x[:5] + "q" + x[5:], x[:4] + x[5:])]
    got = {(r.a, r.b) for r in merge.similar_pairs(spark.createDataFrame(rows, "node string, canonical string, label string")).collect()}
    want = {(a, b) for a, *_ in rows for b, *_ in rows if a < b and abs(len(a) - len(b)) <= 2 and similarity({y: y for y, *_ in rows}, a, b) >= 0.8}
    assert got == want and len(want) > 5


def test_merge_over_clusters(spark):
    found = {r.node: r for r in QUERIES["merge_similarity_clusters"](spark, "/root/testdata/sf0.001").collect()}
    from brindle.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    nodes = {r.node: r for r in v.nodes.collect()}
    mapping = {r.node: r.canonical_node for r in merge.clusters(merge.similar_pairs(v.nodes, 0.9), v.nodes).collect()}
    assert mapping and set(found) == set(nodes) - set(mapping)
    for k, r in found.items():
        own = [n for n in nodes if mapping.get(n, n) == k]
        assert r.mention_count == sum(nodes[n].mention_count for n in own)
        assert r.aliases.split(",") == sorted({a for n in own for a in nodes[n].aliases})


def test_blocks_of_names_are_all_pairs(spark, monkeypatch):
    """Pairs are made in blocks, equal the plain ratio, and are no rows before."""
    monkeypatch.setattr(merge, "BLOCK", 40)
    rows = [(lab, x[:1], x) for x in [*names(4, 200), "", "a" * 70, "a" * 68 + "bc"] for lab in ("PER", "LOC")[: 1 + len(x) % 2]]
    df = spark.createDataFrame([*rows, rows[0], (None, "a", "a"), ("PER", None, "a"), ("PER", "a", None)], "label string, key string, canonical string").repartition(3)
    bases = {r.c: r.b for r in df.where("canonical is not null").select(F.col("canonical").alias("c"), base_form(F.col("canonical")).alias("b")).collect()}
    want = {(la, a, b): similarity(bases, a, b) for la, ka, a in rows for lb, kb, b in rows if (la, ka) == (lb, kb) and a < b}
    found = merge.scores_within(df)
    got = [((r.label, r.a, r.b), r.similarity) for r in found.collect()]
    assert len(got) == len(want) > 5_000 and dict(got) == want
    assert merge.scores_within(df.limit(0)).isEmpty()
    plan = QUERIES["entity_similarity_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
