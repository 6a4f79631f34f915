"""Centroid clustering with Elkan's bounds, in whole numbers.

A component x is floor(64 * x), so that squared distances are exact. Each vector keeps an upper bound of the distance to its centroid and a lower
bound of the distance to every centroid, in a table written after each round. When centroids move, the bounds are
widened by how far they moved. A distance isn't calculated if the upper bound is below the lower one, or below half the distance
between the two centroids. Upper bounds are rounded up and lower ones down, and only a strictly smaller bound
prunes, so a centroid that ties is always compared, in exact whole numbers.

A round reads the table, writes the next one, and adds up its vectors by cluster in the tasks. The driver gets the
sums of each cluster and dimension, and tasks get the centroids and the distances between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import small_batches, table
from brindle.session import cut_lineage, table_path

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components are below this, so that a squared distance fits in a long.
LARGEST = 2.0**20


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Rounded down twice, as a cast may round up; not below zero."""
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf).astype(kind), kind(-np.inf)), kind(0))


@dataclass
class Bounds:
    """The cluster of each of some vectors, an upper bound of the distance to its centroid, and lower bounds to all; skipped counts distances that weren't calculated."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    skipped: int = field(default=0)


def unknown(rows: int, centroids: int) -> Bounds:
    return Bounds(np.zeros(rows, np.int32), np.full(rows, np.inf), np.zeros((rows, centroids), np.float32))


def moved(b: Bounds, before: np.ndarray, after: np.ndarray) -> Bounds:
    """The bounds after the centroids moved."""
    far = _up(np.sqrt(((before - after) ** 2).sum(axis=1)))
    return Bounds(b.cluster, _up(b.upper + far[b.cluster]), _down(b.lower.astype(float) - far, np.float32))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs."""
    d = x - centroids
    return np.einsum("ij,ij->i", d, d)


def assigned(x: np.ndarray, centroids: np.ndarray, b: Bounds) -> Bounds:
    """Each vector's nearest centroid, of those at the same distance the first."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    half = _down(np.sqrt(apart) / 2)
    cluster, upper, lower = b.cluster.copy(), b.upper.copy(), b.lower.copy()
    own = np.full(len(x), -1, np.int64)  # the exact distance to the own centroid, where it is known
    calculated = 0
    for c in range(len(centroids)):
        near = lambda rows: rows[(upper[rows] >= lower[rows, c]) & (upper[rows] >= half[cluster[rows], c])]  # noqa: B023, E731
        rows = near(np.flatnonzero(cluster != c))
        loose = rows[own[rows] < 0]
        own[loose] = squared(x[loose], centroids[cluster[loose]])
        upper[loose] = _up(np.sqrt(own[loose]))
        lower[loose, cluster[loose]] = _down(np.sqrt(own[loose]), np.float32)
        rows = near(rows)
        found = squared(x[rows], centroids[c])
        lower[rows, c] = _down(np.sqrt(found), np.float32)
        nearer = (found < own[rows]) | ((found == own[rows]) & (c < cluster[rows]))
        rows, found, n = rows[nearer], found[nearer], len(rows)
        cluster[rows], own[rows], upper[rows] = c, found, _up(np.sqrt(found))
        calculated += n + len(loose)
    return Bounds(cluster, upper, lower, b.skipped + len(x) * len(centroids) - calculated)


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): whole numbers as bytes of 32-bit integers, of vectors of that length without null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not v.is_valid or len(v.values) != dimensions or v.values.null_count:
                    continue
                c = v.values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(c).all():
                    continue
                if np.abs(c).max() >= LARGEST:
                    raise ValueError(f"components must be below {LARGEST}")
                ids.append(i)
                rows.append(np.floor(c * SCALE).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "x"])

    return embeddings.select(F.col(key).cast("long").alias("vec_id"), vector).mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def seeds(vectors: DataFrame, count: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors of the smallest hashes of seed and vec_id, in that order; rows without a vec_id are none."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(h.alias("h"), "x").orderBy("h", F.hex("x")).limit(count).collect()
    return np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<i4").reshape(-1, dimensions).astype(np.int64)


def _step(rows: DataFrame, before: np.ndarray | None, now: np.ndarray, last: bool) -> DataFrame:
    """rows (vec_id, x, and bounds if there was a round before) assigned to the centroids: with new bounds, or with exact distances at last."""
    k, dimensions = now.shape
    names = ["vec_id", "cluster", "distance"] if last else ["vec_id", "x", "cluster", "upper", "lower"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            x = _matrix(batch.column(1), dimensions)
            b = unknown(len(x), k)
            if before is not None:
                lower = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f4").reshape(-1, k)
                b = moved(Bounds(batch.column(2).to_numpy(), batch.column(3).to_numpy(), lower), before, now)
            b = assigned(x, now, b)
            if last:
                columns = [batch.column(0), pa.array(b.cluster), pa.array(squared(x, now[b.cluster]))]
            else:
                columns = [batch.column(0), batch.column(1), pa.array(b.cluster), pa.array(b.upper), pa.array([r.tobytes() for r in b.lower.astype("<f4")], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long" if last else "vec_id long, x binary, cluster int, upper double, lower binary")


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty cluster's centroid stays."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)

        def told() -> pa.RecordBatch:
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

        for batch in small_batches(batches, 4096):
            cluster = batch.column(0).to_numpy()
            np.add.at(sums, cluster, _matrix(batch.column(1), dimensions))
            counts += np.bincount(cluster, minlength=k)
            if counts.sum() > 1 << 36:  # sums stay below 2 ** 62
                yield told()
                sums[:], counts[:] = 0, 0
        yield told()

    parts = rows.select("cluster", "x").mapInArrow(run, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    now = centroids.copy()
    for r in each.collect():  # a row for each cluster and dimension
        now[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return now


def clustered(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of so many dimensions.

    distance is squared, and inertia its sum over the cluster and over all. Rows are left out whose vector is null, of another length, or holds
    null or non-finite components. Of centroids at the same distance a vector takes the one of the smaller number.
    Repeated rows are vectors of their own, and can each be a first centroid; rows without a vec_id are
    clustered, but are no first centroids. With fewer vectors than centroids there are as many centroids as vectors with an id, and
    without any there are no rows, as of an empty table. Components of an absolute value of 2 ** 20 or more raise ValueError. Other columns are left out.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, dimensions, key, vector)
    before, now = None, seeds(vectors, centroids, seed, dimensions)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = vectors
    for _ in range(rounds):
        path = table_path(spark, "bounds")
        _step(rows, before, now, False).write.option("compression", "zstd").parquet(path)
        rows = spark.read.parquet(path)
        before, now = now, _means(rows, now)
    found = cut_lineage(_step(rows, before, now, True))
    per = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(per.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    known = spark.createDataFrame([(c, int(s), int(total), digests[c]) for c, s in sorted(per.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clustered() of all embeddings; odd rows and empty tables as stated there."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _round_sql(i: int) -> str:
    """Assignment a<i> to centroids c<i>, and the centroids after it."""
    return f"""
a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {CENTROIDS} + k) AS m FROM e, c{i} GROUP BY rid),
p{i} AS MATERIALIZED (SELECT rid, vec_id, x, m % {CENTROIDS} AS k, m // {CENTROIDS} AS distance FROM a{i}),
s{i} AS (SELECT k, d, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT k, unnest(x) AS v, unnest(range({DIMENSIONS})) AS d FROM p{i}) GROUP BY k, d),
m{i} AS (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY d) AS c FROM s{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)"""


OP13_SQL = f"""
WITH e AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k, x AS c FROM e WHERE vec_id IS NOT NULL
    QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) <= {CENTROIDS}
),{",".join(_round_sql(i) for i in range(ROUNDS + 1))},
r AS (SELECT vec_id, k, distance FROM p{ROUNDS})
SELECT r.vec_id, r.k::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY r.k)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM r JOIN c{ROUNDS} AS c ON r.k = c.k
"""
