"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its NEAREST nearest reference points (pivots). Two vectors are
candidates if their descriptions share at least two pivots: the inverted lists are kept per
pair of pivots, so whoever meets in a list shares both. The number of pivots grows with the
square root of the number of vectors, so that lists keep their length. Lists are compared in blocks of
bounded size, and every candidate's cosine is verified in double precision. A pair that
meets in several lists counts in the list of its two smallest shared pivots only, so blocks
give sums per vector and never rows per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm._common import block_pairs, each_block, labels_within, small_batches, table
from brindle.operators.components import connected_components
from brindle.session import cut_lineage

LEAST_COSINE = 0.9
#: Reference points: a power of two from the square root of the number of vectors times ROOT, within bounds. They are taken from
#: SAMPLED times as many vectors of smallest hash, no two of a cosine of APART or more, and seeded directions where these are too few.
PIVOTS, MOST_PIVOTS, ROOT, SAMPLED, APART, SEED = 256, 8192, 2, 4, 0.5, 5
#: Nearest pivots that describe a vector, and those more for each doubling of the least number of pivots.
NEAREST, MORE = 7, 1
#: Lengths of vectors that get pivots of their own; vectors of rarer lengths share one list for each length.
MOST_LENGTHS = 16
#: Vectors of a list that are compared with so many others at a time.
BLOCK = 1024


def pivots_for(vectors: int) -> tuple[int, int]:
    """(pivots, nearest) for so many vectors."""
    doublings = 0
    while PIVOTS << doublings < min(ROOT * vectors**0.5, MOST_PIVOTS):
        doublings += 1
    return PIVOTS << doublings, NEAREST + MORE * doublings


def _kind(embeddings: DataFrame, column: str) -> str:
    return "<f8" if embeddings.schema[column].dataType == T.ArrayType(T.DoubleType()) else "<f4"


def packed(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, raw): the vector's bytes; null if it is null, empty or zero, or holds null or non-finite components."""
    kind = np.dtype(_kind(embeddings, vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
                raw.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return embeddings.select(key, vector).mapInArrow(run, "vec_id long, raw binary")


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; all of the same length."""
    x = np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(points: np.ndarray, most: int, least_apart: float = APART) -> np.ndarray:
    """The first points of which no two have a cosine of ``least_apart`` or more.

    A dense group gets one pivot: if it had many, which of them are nearest would differ within the group.
    """
    kept: list[np.ndarray] = []
    for x in points:
        if len(kept) == most:
            break
        if not kept or (np.array(kept) @ x).max() < least_apart:
            kept.append(x)
    return np.array(kept).reshape(-1, points.shape[1])


def choose_pivots(classes: DataFrame, kind: str, most: int = PIVOTS, seed: int = SEED) -> dict[int, np.ndarray]:
    """Unit reference points for the commonest lengths of vectors, by their bytes; at most SAMPLED * ``most`` vectors are collected per length."""
    lengths = [r[0] for r in classes.groupBy(F.octet_length("raw").alias("n")).count().orderBy(F.desc("count"), "n").limit(MOST_LENGTHS).collect()]
    out = {}
    for n in sorted(lengths):
        rows = classes.where(F.octet_length("raw") == n).orderBy(F.xxhash64(F.lit(seed), "raw"), "raw").limit(SAMPLED * most).collect()
        points = spread(unit([bytes(r["raw"]) for r in rows], kind), most)
        fill = np.random.default_rng(seed).normal(size=(most - len(points), points.shape[1]))
        out[n] = np.concatenate([points, fill / np.linalg.norm(fill, axis=1, keepdims=True)])
    return out


def described(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of each vector's nearest pivots, ascending; where pivots tie the smaller number is taken."""
    order = np.argsort(-np.round(x @ pivots.T, 12), axis=1, kind="stable")[:, :nearest]
    return np.sort(order, axis=1)


def _lists(classes: DataFrame, pivots: dict[int, np.ndarray], kind: str, nearest: int) -> DataFrame:
    """(key, c, tops): a row for each vector and pair of its pivots, with the list's key."""
    pairs = np.array(list(combinations(range(nearest), 2)))
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # as many vectors as there are pivots, for MOST_LENGTHS lengths at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = batch.column(1).to_pylist()
            for n in sorted({len(r) for r in raw}):
                rows = np.array([i for i, r in enumerate(raw) if len(r) == n])
                if n not in shared.value:  # a rare length: one list of its own, under a pair that no pivots have
                    keys, at = np.full(len(rows), -n), rows
                    tops = np.tile(np.arange(nearest, dtype="<u2"), (len(rows), 1))
                else:
                    points = shared.value[n]
                    tops = described(unit([raw[i] for i in rows], kind), points, nearest).astype("<u2")
                    keys = (tops[:, pairs[:, 0]].astype(np.int64) * len(points) + tops[:, pairs[:, 1]] + n * len(points) ** 2).ravel()
                    at = np.repeat(rows, len(pairs))
                    tops = np.repeat(tops, len(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(at)), pa.array([t.tobytes() for t in tops], pa.binary())], ["key", "c", "tops"])

    return classes.select("c", "raw").mapInArrow(run, "key long, c long, tops binary")


def compared(c: np.ndarray, raw: list[bytes], n: np.ndarray, tops: np.ndarray, side: np.ndarray, cross: bool, key: int, kind: str, least: float, most: int = PIVOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, smallest c that its links reach here, links) of the rows of one block that have links counted in this list."""
    x = unit(raw, kind)
    if cross:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(x[left] @ x[right].T >= least)
        i, j = left[i], right[j]
    else:
        i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    a, b = divmod(key % (most * most), most) if key >= 0 else (0, 1)
    mine = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 17):
        ti, tj = tops[i[s : s + (1 << 17)]], tops[j[s : s + (1 << 17)]]
        both = (ti[:, :, None] == tj[:, None, :]).any(axis=2)
        # its own two pivots are shared by all; the pair counts here if none of the shared ones is smaller
        mine[s : s + (1 << 17)] = ~(both & (ti < b) & (ti != a)).any(axis=1)
    i, j = i[mine], j[mine]
    links = np.zeros(len(c), np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    label = labels_within(len(c), i, j, c)
    rows = np.flatnonzero(links)
    return rows, label[rows], links[rows]


def _compare(blocks: DataFrame, kind: str, least: float, most: int) -> DataFrame:
    """Runs over sorted blocks; the rows of one block, at most about two times BLOCK, are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_block(batches):
            if t.num_rows < 2:
                continue
            c, raw, n = t["c"].to_numpy(), t["raw"].to_pylist(), t["n"].to_numpy()
            tops = np.frombuffer(b"".join(t["tops"].to_pylist()), "<u2").reshape(len(raw), -1).astype(np.int64)
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            rows, label, links = compared(c, raw, n, tops, (t["chunk"].to_numpy() == hi).astype(int), lo != hi, t["key"][0].as_py(), kind, least, most)
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]), pa.array(label), pa.array(links)], ["c", "label", "links"])

    return blocks.mapInArrow(run, "c long, label long, links long")


def linked(embeddings: DataFrame, least: float = LEAST_COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row.

    Links are pairs of cosine ``least`` or more that the index finds. Equal vectors are
    one class from the start: they link with each other, and are compared with others once. Null and zero
    vectors, and those with null or non-finite components, have no links and are
    their own component; so do vectors of another length. Each repeated row is a vector of its own. A null vec_id can be linked
    but is no component_id unless all of its component are null. An empty table gives no rows; other columns are left out.
    """
    kind = _kind(embeddings, vector)
    rows = cut_lineage(packed(embeddings, key, vector))
    classes = rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = cut_lineage(classes.withColumn("c", F.monotonically_increasing_id()))
    most, nearest = pivots_for(classes.count())
    lists = cut_lineage(_lists(classes, choose_pivots(classes, kind, most), kind, nearest))
    # a list of one vector has nobody to meet, so its vector isn't sent there
    sizes = lists.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = cut_lineage(sizes)
    hot = cut_lineage(sizes.where(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("chunks")))
    met = lists.join(sizes.select("key"), "key", "left_semi").join(classes.select("c", "raw", "n"), "c")
    found = cut_lineage(_compare(block_pairs(met, hot, "c", "c", "raw", "n", "tops"), kind, least, most))
    roots = connected_components(found, "c", "label").select(F.col("node").alias("c"), F.col("component").alias("root"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    placed = classes.join(links, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(smallest, "root").select("raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    valid = rows.where("raw is not null").join(known, "raw").select("vec_id", "n_links", "component_id")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.union(alone)


def op7_pivot_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked() of all embeddings; odd rows and empty tables as stated there."""
    found = linked(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
