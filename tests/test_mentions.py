"""Mentions: the first place of each form, and how it is found."""

from pyspark.sql import functions as F

from brindle.operators.graph import found_mentions
from brindle.plans.registry import QUERIES
from brindle.sources.views import NAME


def test_first_places(spark):
    texts = ["Thater saw That and That", "é🙂 Über Anna, Anna\x00Bert", "", None, "none", "McAnna Anna"]
    a = spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumn("discovered_at", F.lit(None).cast("timestamp_ntz"))
    found = found_mentions(a.repartition(2), NAME)
    assert sorted((r.article_id, r.text, r.start, r.stop) for r in found.collect()) == [(0, "That", 0, 4), (0, "Thater", 0, 6), (1, "Anna", 8, 12), (1, "Bert", 19, 23), (5, "Anna", 2, 6)]
    assert "instr" not in found._jdf.queryExecution().optimizedPlan().toString()  # a pass over the text for each form, letter by letter


def test_texts_are_read_once_for_a_merge(spark):
    plan = QUERIES["merge_node_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "text#" in plan and "regexp_extract_all" not in plan
