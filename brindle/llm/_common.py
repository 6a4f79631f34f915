"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a word: the six ASCII white spaces. bytes.split() and bytes.strip() without arguments use the same set.
WHITE = b" \t\n\x0b\x0c\r"

#: Rows in a batch that Python works on at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that Python objects of few rows exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """work() over small batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield work(batch)

    return df.mapInArrow(run, schema)


def join_measured(left: DataFrame, right: DataFrame, on: str, how: str, most_rows: int = 10_000) -> DataFrame:
    """left joined with a side of one row per key: broadcast only if that side is counted to be small.

    Beyond the bound it is an ordinary shuffled join, whose hot keys AQE splits.
    ``right`` should be cheap to count (a checkpoint, or a small aggregate).
    """
    small = right.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def each_block(batches: Iterable[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """The rows of sorted batches that agree in their first columns (longs), one block in memory at a time."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
            if e == s:
                continue
            now = tuple(ids[s])
            if held and now != at:
                yield pa.Table.from_batches(held)
                held = []
            at = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, hot: DataFrame, salt: str, *carried: str) -> DataFrame:
    """(key, lo, hi, chunk, carried...): the rows of a key with ``chunks`` in ``hot`` in every pair of its chunks, others in one block, dealt and sorted by block."""
    listed = join_measured(rows, hot, "key", "left")
    chunked = listed.withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.expr(f"cast(pmod(xxhash64({salt}, key), chunks) as int)")))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = chunked.withColumn("other", other).select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", *carried)
    return blocks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def labels_within(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each of n rows reaches over the links (i, j)."""
    label = label.copy()
    while n:
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (old == label).all():
            break
    return label
