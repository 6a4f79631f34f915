"""The pipeline's stages against plain forms, the registered queries, and their SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import mixing, pieces, secrets
from brindle.llm.registry import QUERIES, SQL
from tests.llm.test_llm import SF, brute_spans, empty, odd
from tests.llm.test_near_copies import brute_groups


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("component_id", F.lit("own"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        kept.append((docs, out))
        docs = out
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, good = map(texts, kept[0])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = [r.quality for r in labels.collect() if r.doc_id not in good]
    assert rejected and sum(rejected) <= 0.1 * len(rejected)
    _, single = map(texts, kept[1])
    groups, _ = brute_groups(good)  # five words and a similarity of 0.8, as a stage on word shingles is to take
    assert set(single) == set(groups.values())
    _, masked = map(texts, kept[2])
    for i, x in single.items():
        assert (secrets.MASK in masked[i]) == bool(brute_spans(x)) and (brute_spans(x) or masked[i] == x)
    rates = {r.source: r.rate for r in mixing.repetition_rates(kept[3][0]).collect()}
    n = {r.doc_id: r["count"] for r in kept[3][1].groupBy("doc_id").count().collect()}
    source = {r.doc_id: r.source for r in kept[3][0].collect()}
    assert set(n) <= set(source) and abs(sum(n.values()) - sum(rates[s] for s in source.values())) < 6 * len(source) ** 0.5
    encoder = pieces.Encoder(pieces.Vocabulary(pieces.default_model()))
    for r in kept[4][1].collect():
        assert list(r.ids) == encoder.encode([masked[r.doc_id]])[0] and r.n_tokens == len(r.ids)


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_scores_of_a_query(spark):
    rows = QUERIES["op4_quality_ranking"](spark, SF).collect()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.fingerprint for r in QUERIES["op9_simhash_near_dups"](spark, SF).limit(5).collect()}
