"""Searches of many queries count the asked words only, and triples look at texts with a phrase only."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as t
from brindle.operators import graph, index, search


@pytest.mark.parametrize("most", [200_000, 0])
def test_only_asked_words_are_counted(spark, monkeypatch, most):
    monkeypatch.setattr(index, "MOST_TERMS", most)  # 0: joined by a shuffle
    rows = spark.createDataFrame([(1, "Cold rain", "rain, rain and sun"), (2, None, "sun")], "id long, title string, content string")
    told = search.with_tokens(rows)
    asked = spark.createDataFrame([("rain",), ("sun",), ("rain",), ("snow",)], "term string")
    got = index.counted(told, asked, "id")
    assert {(r.term, r.id, r.n) for r in got.collect()} == {("rain", 1, 3), ("sun", 1, 1), ("sun", 2, 1)}
    queries = spark.createDataFrame([(0, ["rain", "sun"]), (1, ["sun"])], "query_id long, terms array<string>")
    ranks = lambda found: {(r.query_id, r.id): r.rank for r in index.search_many(found, queries).collect()}
    assert ranks(got) == ranks(index.postings(told)) != {}


def test_texts_without_a_phrase_are_left_out(spark):
    texts = ["Anna sÄid so", "Anna ap-pointed\n Bert", "met    with", "met. With", "nothing", None, "Поseduva"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {r.id: (r.p is not None, r.t) for r in df.select("id", t.predicate(F.col("content")).alias("p"), t.tells(F.col("content")).alias("t")).collect()}
    assert all(a == b for a, b in got.values()) and sum(a for a, _ in got.values()) >= 3
    mentions = spark.createDataFrame([(0, "n", 0, 4, 0.9)], "article_id long, node string, start long, stop long, confidence double")
    first = graph.relationship_triples(df, mentions)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in first
