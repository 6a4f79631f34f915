"""Large rates are drawn in parts, whole documents are mixed, and the report of ablations is its SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from brindle.llm import mixing
from brindle.llm.registry import REPORTS, REPORTS_SQL
from tests.llm.test_llm import SF, odd


def test_large_rates_keep_mean_and_variance(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("some").alias("source"))
    out = mixing.poisson_replicas(docs, {"rare": 0.999, "some": 0.001}, total=250.0)
    n = {r.doc_id: (r["count"], r.replicas, r.last) for r in out.groupBy("doc_id").agg(F.count("*").alias("count"), F.max("replicas").alias("replicas"), F.max("replica").alias("last")).collect()}
    assert abs(n[0][0] - 99_900) < 6 * 99_900**0.5 and all(a == b == c + 1 for a, b, c in n.values())
    assert out.select("doc_id", "replica").distinct().count() == out.count()
    rates = spark.range(1).select(mixing.drawn_counts(mixing.cumulative(F.lit(10.0)), F.lit(5).cast("long"), 1, F.lit(1)).alias("c")).first().c
    assert len(rates) == 5
    many = spark.range(4000).select(F.aggregate(mixing.drawn_counts(mixing.cumulative(F.lit(12.5)), F.lit(4).cast("long"), 3, F.col("id")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    values = np.array([r.n for r in many.collect()])
    assert abs(values.mean() - 50) < 0.6 and abs(values.var() - 50) < 5


def test_whole_documents_are_mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    rows = mixing.op3_poisson_replicas(spark, SF).collect()
    assert rows and all(whole[r.doc_id] == r.text for r in rows)
    own = odd(spark).withColumn("source_name", F.lit("own")).withColumn("place", F.lit("own"))
    out = mixing.shuffled(mixing.poisson_replicas(own, total=30.0))
    assert {(r.source_name, r.place) for r in out.collect()} == {("own", "own")} and {"replica", "replicas", "rate"} <= set(out.columns)


def test_reports_are_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    for name, make in REPORTS.items():
        df, cursor = make(spark, SF), con.execute(REPORTS_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))
