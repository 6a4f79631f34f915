"""From raw documents to token ids in five stages, each over all that the one before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Extra columns are carried along by the first four.
Nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say: rows that repeat
a doc_id and text are one document from the second stage on, and a group of near copies keeps one text
even where doc_ids are null or repeated with other texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, near_copies, pieces, quality_ranking, secrets
from brindle.llm._common import table
from brindle.session import table_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the pairwise ranking, learnt from labels of the documents at hand, predicts to be bad."""
    return quality_ranking.good_only(docs, quality_ranking.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id: SimHash of five-word shingles by Golay keys, and a Jaccard similarity of 0.8 or more."""
    return near_copies.one_of_each_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in their texts are masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until sources have their target weights in expectation, in shuffled order."""
    whole = docs.select("doc_id", "source", F.struct("*").alias("document"))
    return mixing.shuffled(mixing.poisson_replicas(whole)).select("document.*")


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document, and the digest of the text that the ids decode to."""
    return pieces.encode(docs, carry=("doc_id", "lang", "source"), decoded=True)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate removal", keep_one_of_each_group),
    ("secret masking", mask_secrets),
    ("source mixing", mix_sources),
    ("token ids", to_ids),
]
#: Neither learning nor fingerprints nor merges of pieces can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder, so that no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            path = table_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
