"""Embedding whitening: Spark MLlib's RowMatrix over exactly centred rows, a local eigh, and a broadcast projection.

A component c becomes the whole number x = floor(64 * c) + 1000000. The model is fitted on each different x-vector
once: n of them, with sums S. n * x - S is exact, and is divided by n once, so rows are centred before anything is
multiplied, and nothing is cancelled. computeGramianMatrix of these rows over n is the covariance V, whose
eigenvectors are the components; a vector's share of one is its projection over the root of the eigenvalue.
Only sums, V and the model reach the driver, whose sizes depend on the length of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import small_batches, table
from brindle.session import table_path

SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 16
#: Components of a smaller share of all variance are rounding; they have no scale to be divided by.
LEAST_SHARE = 1e-12
#: 64 times a component below this is exact as a double.
LARGEST = 2.0**47


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, and for each component a column of ``project`` and its share of the variance."""

    n: int
    sums: np.ndarray  # of Python numbers, which don't overflow
    project: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:  # the sums are no larger
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2, exact; None where it doesn't fit in a long."""
        d = self.deviations(x)
        if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) >= 1 << 63:
            d = d.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def whole_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): whole numbers as bytes of 64-bit integers, of rows whose vector is neither null nor empty, nor holds null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                c = v.values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(c).all():
                    continue
                if np.abs(c).max() >= LARGEST:
                    raise ValueError(f"components must be below {LARGEST}")
                x = np.floor(c * SCALE)
                ids.append(i)
                rows.append((x.astype(np.int64) + SHIFT).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "x"])

    return embeddings.select(F.col(key).cast("long").alias("vec_id"), vector).mapInArrow(run, "vec_id long, x binary")


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), -1)


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S) of a fit list of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                x = _matrix(batch.column(0).to_pylist()).astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([[str(v) for v in x]])], ["n", "sums"])

    parts = fit.select("x").mapInArrow(run, "n long, sums array<string>")
    each = parts.select("n", F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["d"]: (r["n"], int(r["s"])) for r in each.collect()}  # a row for each dimension
    return (found[0][0], np.array([found[d][1] for d in range(len(found))], object)) if found else (0, np.zeros(0, object))


def _gramian(fit: DataFrame, rows, n: int, width: int) -> np.ndarray:
    """The Gramian over n of what rows() makes of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(rows(_matrix(batch.column(0).to_pylist()))), pa.list_(pa.float64()))], ["v"])

    vectors = fit.select("x").mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, width).computeGramianMatrix().toArray() / n


def fitted(fit: DataFrame, most: int = MOST_COMPONENTS) -> Whitening:
    """The whitening of a fit list (x) of one length: each different vector once."""
    n, sums = _sums(fit)
    model = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0))
    if not n:
        return model
    covariance = _gramian(fit, model.centred, n, len(sums))
    total = float(np.trace(covariance))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > LEAST_SHARE * total
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return model
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])  # the largest entry is positive
    project = vectors / np.sqrt(values)
    again = _gramian(fit, lambda x: model.centred(x) @ project, n, len(values))
    return Whitening(n, sums, project, values / total, float(np.abs(again - np.eye(len(values))).max()))


def whitened(embeddings: DataFrame, most: int = MOST_COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Components are numbered from 1 by falling variance. Rows are left out whose vector is null or empty or holds null or
    non-finite components. Vectors of each length are fitted on their own. A component whose share of the variance is rounding has no scale, and is left out,
    so that fewer than two different vectors give no rows. Equal vectors count once in the fit, and each
    repeated row has rows of its own; so do null vec_ids. deviation is null where it doesn't fit in a long. Components of an absolute value of
    2 ** 47 or more raise ValueError. An empty table gives no rows; other columns are left out.
    """
    spark, path = embeddings.sparkSession, table_path(embeddings.sparkSession, "fit-list")
    rows = whole_vectors(embeddings, key, vector)
    rows.select("x").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    lengths = [r[0] for r in fit.select(F.octet_length("x").alias("n")).distinct().collect()]
    models = spark.sparkContext.broadcast({n: fitted(fit.where(F.octet_length("x") == n), most) for n in sorted(lengths)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in frame.groupby(frame["x"].map(len), sort=True):
                model = models.value[n]
                width = len(model.explained)
                for start in range(0, len(part) if width else 0, 1000):
                    some = part.iloc[start : start + 1000]
                    x = _matrix(some["x"].tolist())
                    yield pd.DataFrame({
                        "vec_id": some["vec_id"].astype("Int64").repeat(width).array,
                        "component": np.tile(np.arange(1, width + 1, dtype=np.int32), len(some)),
                        "n": model.n,
                        "deviation": pd.array(model.squares(x), dtype="Int64").repeat(width),
                        "whitened": (model.centred(x) @ model.project).ravel(),
                        "explained": np.tile(model.explained, len(some)),
                        "identity_error": model.identity_error,
                    })

    return rows.mapInPandas(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened() of all embeddings; odd rows and empty tables as stated there."""
    return whitened(table(spark, sf_dir, "embeddings"))
