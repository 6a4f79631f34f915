"""The pipeline's last stage decodes its ids again."""

import hashlib

import corpus_pipeline
from brindle.llm import pieces
from tests.llm.test_llm import SF, empty, odd


def test_ids_are_decoded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(odd(spark).where("doc_id is not null").selectExpr("-doc_id", "text", "lang", "source", "n_chars"))
    out = corpus_pipeline.to_ids(spark, docs, SF)
    rows, texts = out.collect(), {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    of = {r.doc_id: r.decoded_sha256 for r in pieces.digests(docs).collect()}
    assert all(of[r.doc_id] == r.decoded_sha256 for r in rows)
    assert corpus_pipeline.to_ids(spark, empty(spark), SF).count() == 0
