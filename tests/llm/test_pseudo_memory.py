"""Totals of words go to their slices as rows, and none are collected in the JVM; documents are dealt to groups once for all rounds."""

from pyspark.sql import functions as F

from brindle.llm import pseudo_likelihood as pl
from tests.llm.test_llm import odd


def test_nothing_is_collected(spark, monkeypatch):
    docs = odd(spark)
    words = pl.Words.of(docs)
    scores = pl.score(docs, words, pl.Network.fresh())
    assert "collect_list" not in scores._jdf.queryExecution().toString()
    times = []
    monkeypatch.setattr(pl, "_dealt", lambda *a, dealt=pl._dealt: times.append(1) or dealt(*a))
    taken = []
    monkeypatch.setattr(pl, "_train", lambda dealt, *a, train=pl._train: taken.append(dealt._jdf.queryExecution().optimizedPlan().toString()) or train(dealt, *a))
    pl.train(docs, words)
    assert len(times) == 1 and len(taken) == pl.ROUNDS and not any("MapInArrow" in plan for plan in taken)


def test_few_slices_are_read_at_once(spark):
    """A reader holds the rows of a file at once, so that a file has few slices however many a task writes."""
    n = 5 * pl.FILE_SLICES
    kinds = pl.SLICE.removeprefix("slice long, ").split(", ")
    slices = spark.range(n).coalesce(1).selectExpr("id as slice", *[f"cast(null as {k.split(' ')[1]}) as {k.split(' ')[0]}" for k in kinds])
    files = [r["count"] for r in pl.written(slices).select(F.input_file_name().alias("file")).groupBy("file").count().collect()]
    assert sum(files) == n and max(files) <= pl.FILE_SLICES
