"""Every query against its SQL on the smallest tables, and the streaming forms against their batch forms."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.operators import alerts
from brindle.plans.registry import QUERIES, SQL
from brindle.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    assert ordered(df.collect(), df.columns) == ordered(cursor.fetchall(), [c[0] for c in cursor.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def parts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_windows_stream(spark, tmp_path):
    stream = jobs.stream_of(spark, parts(spark, tmp_path), jobs.EVENTS)
    jobs.windowed_counts(stream, late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.start, r.event_type, r.n) for r in spark.table("w").collect()} == {(r.w.start, r.event_type, r.n) for r in batch.collect()}


def test_first_seen_and_retries_stream(spark, tmp_path):
    path = parts(spark, tmp_path)
    jobs.first_seen(jobs.stream_of(spark, path, jobs.EVENTS), "user_id", "ts", "60 days").writeStream.format("memory").queryName("f").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("f").count() == spark.read.parquet(path).select("user_id").distinct().count()
    tries = jobs.stream_of(spark, path, jobs.EVENTS, 9).select(F.col("user_id").alias("id"), (F.col("event_id") >= 0).alias("failed"))
    jobs.retry_states(tries).writeStream.format("memory").queryName("r").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {r.status for r in spark.table("r").collect()} == {"failed"}


def test_alert_stream(spark, tmp_path):
    a = spark.createDataFrame([(i, f"t{i}", "bad news" if i % 2 else "none", "en", 0.0) for i in range(8)], "id long, title string, content string, language string, sentiment_score double")
    a.repartition(3).write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([(1, "k", "bad", None, None, None, "both", True)], alerts.RULES)
    m = spark.createDataFrame([], "article_id long, node string")
    for k in range(2):  # the second run reads all again, and adds nothing
        jobs.alert_stream(jobs.stream_of(spark, str(tmp_path / "in"), "id long, title string, content string, language string, sentiment_score double"), rules, m, str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4
