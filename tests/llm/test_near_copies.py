"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import near_copies
from tests.llm.test_llm import DOC, SF, empty, odd


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_groups(texts):
    """The smallest key of each key's group, and the pairs that aren't copies."""
    sets, near = {k: brute_shingles(x) for k, x in texts.items()}, set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b:
                shared, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if shared >= 0.8 * both:
                    near |= {(a, b)} if shared < both else set()
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {k: top(k) for k in sets}, near


def varied():
    """Texts with near copies of some changed words, from far below the threshold to just above it."""
    rng = random.Random(3)
    texts = {}
    for base in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 20, 60, 200, 700]))]
        for _ in range(4):
            texts[len(texts)] = " ".join(words)
            changed = list(words)
            for i in rng.sample(range(len(words)), min(len(words), rng.choice([0, 1, max(1, len(words) // 60), len(words) // 30, len(words) // 10]))):
                changed[i] = f"x{rng.randrange(3000)}"
            words = changed
    return texts


def stage(spark, texts):
    docs = spark.createDataFrame([(k, x, "en", "s", None) for k, x in texts.items()], DOC).repartition(3)
    return {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()}


def test_stage_against_brute_force(spark):
    texts = varied()
    groups, near = brute_groups(texts)
    assert len(near) > 30 and len({*groups.values()}) > 60
    assert stage(spark, texts) == {*groups.values()}


def test_stage_on_given_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups, near = brute_groups(texts)
    assert near == {(1, 177), (6, 145)}  # 11 and 7 bits apart
    assert stage(spark, texts) == {*groups.values()}


def test_stage_on_odd_tables(spark):
    rows = {(r.doc_id, r.text) for r in near_copies.one_of_each_group(odd(spark)).collect()}
    assert {i for i, _ in rows} == {1, 2, None, 5, 6, 7} and near_copies.one_of_each_group(odd(spark)).columns == odd(spark).columns
    assert near_copies.one_of_each_group(empty(spark)).count() == 0
    nameless = odd(spark).withColumn("doc_id", F.lit(None).cast("long"))
    assert near_copies.one_of_each_group(nameless).count() > 0
