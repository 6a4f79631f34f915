"""A quality classifier learnt from preference pairs (Bradley-Terry).

Each pair is a good and a bad labelled document; the chance that the first is
preferred is the logistic function of the difference of their scores, and a score is
linear in features of the text alone: its surface, and shares of hashed words, word pairs and
character triples. The logistic loss of feature differences, summed over all pairs of the learnable rows
in blocks, is minimised by Newton steps. A document is predicted good if its score lies above the
quantile that matches the share of bad labels, taken over the scores of all learnable
labelled documents, most of which the weights were not fitted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import map_arrow, small_batches, table, text_bytes
from brindle.llm.quality_rules import measured
from brindle.session import cut_lineage

#: Labelled rows of each class that are learnt from at most; the smallest hashes of doc_id are taken. All pairs of them count.
MOST_LABELLED, SEED = 5_000, 11
RIDGE, STEPS = 1e-2, 25
#: The quantile's rank is right to one in so many rows.
ACCURACY = 100_000
SURFACE = ("log_words", "word_length", "symbols", "bangs", "pipes", "capitals", "digits", "distinct", "next_same", "repeated_windows", "duplicate_lines", "stops")
#: Buckets of hashed words, of pairs of words that follow each other, and of three bytes in a row.
WORDS, PAIRS, TRIPLES = 64, 32, 32
N_FEATURES = len(SURFACE) + WORDS + PAIRS + TRIPLES
#: Different words are counted within stretches of so many words, so that long texts don't seem poorer.
STRETCH = 1000
DIGITS, STOPS = b"0123456789", b".,;:?"
#: Words whose hashes a task keeps, and bytes and words that are hashed at a time.
MOST_KNOWN, CHUNK = 300_000, 1 << 16


def surface(text: bytes, words: Sequence[bytes]) -> list[float]:
    """One value for each of SURFACE, all between 0 and 1; there are words."""
    n = len(words)
    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat, n_bangs, n_upper, n_lower = measured(text)
    gone = lambda drop: len(text) - len(text.translate(None, drop))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        min(np.log1p(n) / 12, 1.0),
        min(word_chars / n / 20, 1.0),
        min(n_symbols / n, 1.0),
        min(n_bangs / n, 1.0),
        min(text.count(b"|") / n, 1.0),
        n_upper / max(n_upper + n_lower, 1),
        min(gone(DIGITS) / word_chars, 1.0),
        sum(len(set(words[i : i + STRETCH])) for i in range(0, n, STRETCH)) / n,
        same / n,
        n_repeat / n,
        n_dup_lines / max(n_lines, 1),
        min(gone(STOPS) / n, 1.0),
    ]


class _Hashed(dict):
    """The CRC-32 of each word in lower case."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = zlib.crc32(word.lower())
        return h


class Features:
    """Rows of N_FEATURES values between 0 and 1 for texts; the hashes of words are kept from text to text."""

    def __init__(self) -> None:
        self.known = _Hashed()

    def shares(self, text: bytes, words: Sequence[bytes]) -> np.ndarray:
        """The roots of the shares of each bucket; a word pair is 31 times the first hash plus the second, a triple is a number to base 31."""
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        one = np.bincount(hashes % WORDS, minlength=WORDS)
        two = np.bincount((hashes[:-1] * 31 + hashes[1:]) % PAIRS, minlength=PAIRS)
        three = np.zeros(TRIPLES, np.int64)
        data = np.frombuffer(text, np.uint8)
        for i in range(0, max(len(data) - 2, 0), CHUNK):
            x = data[i : i + CHUNK + 2].astype(np.int32)
            three += np.bincount((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) % TRIPLES, minlength=TRIPLES)
        return np.concatenate([np.sqrt(c / max(c.sum(), 1)) for c in (one, two, three)])

    def __call__(self, texts: Sequence[bytes]) -> np.ndarray:
        """A text without words has zeros."""
        rows = np.zeros((len(texts), N_FEATURES))
        for row, text in zip(rows, texts, strict=True):
            if words := text.split():
                row[: len(SURFACE)] = surface(text, words)
                row[len(SURFACE) :] = self.shares(text, words)
        return rows


@dataclass(frozen=True)
class Ranking:
    """score = weights . features - threshold; above 0 is good. ``spread`` is the scale of the logistic score."""

    weights: tuple[float, ...]
    threshold: float
    spread: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the threshold."""
        margin = ((rows * np.array(self.weights)).sum(axis=1) - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _all_pairs(good: np.ndarray, bad: np.ndarray, w: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss over all pairs of a good and a bad row, a block of good rows at a time."""
    high, low, n, d = good @ w, bad @ w, len(good) * len(bad), good.shape[1]
    gradient, curvature, of_low, bent = np.zeros(d), np.zeros((d, d)), np.zeros(len(bad)), np.zeros(len(bad))
    for i in range(0, len(good), block):
        x = good[i : i + block]
        p = 1 / (1 + np.exp(np.clip(high[i : i + block, None] - low[None, :], -500, 500)))  # the chance of the wrong order
        q = p * (1 - p)
        gradient += x.T @ p.sum(axis=1)
        of_low += p.sum(axis=0)
        bent += q.sum(axis=0)
        cross = x.T @ (q @ bad)
        curvature += (x * q.sum(axis=1)[:, None]).T @ x - cross - cross.T
    gradient -= bad.T @ of_low
    curvature += (bad * bent[:, None]).T @ bad
    return gradient / n, curvature / n


def fit(rows: np.ndarray, good: np.ndarray, totals: tuple[int, int] | None = None) -> Ranking:
    """Weights from all pairs, and the threshold from the quantile of the labelled scores.

    ``totals`` are the bad and good labels that the rows were sampled from, by default the
    rows themselves. Without both classes there are no pairs: all weights are 0 and every score is 0.5.
    """
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(above) or not len(below):
        return Ranking((0.0,) * rows.shape[1], 0.0, 1.0)
    w = np.zeros(rows.shape[1])
    for _ in range(STEPS):  # Newton: the loss is convex
        gradient, curvature = _all_pairs(rows[above], rows[below], w)
        step = np.linalg.solve(curvature + RIDGE * np.eye(len(w)), gradient - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = rows @ w
    n_bad, n_good = totals or (len(below), len(above))
    stands = np.where(good, n_good / len(above), n_bad / len(below))  # labels that each row stands for
    order = np.argsort(raw)
    k = int(np.searchsorted(np.cumsum(stands[order]), n_bad * (1 - 1e-9)))  # so many labels are to lie below the threshold
    k = min(k, len(raw) - 2)
    threshold = float((raw[order[k]] + raw[order[k + 1]]) / 2)
    spread = float(np.sqrt(np.average((raw - np.average(raw, weights=stands)) ** 2, weights=stands)))
    return Ranking(tuple(float(v) for v in w), threshold, max(spread / 4, 1e-9))


def _featured(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, text_hash, x) of each row."""
    of = Features()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = of(text_bytes(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "text_hash", "x"])

    return map_arrow(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text), work, "doc_id long, text_hash long, x array<double>")


def held_out(key: str = "doc_id") -> F.Column:
    """Whether labels of this row are never learnt from: CRC-32 of the key as text, modulo 3, is 1; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labelled documents that aren't held out, the lesser label of each."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return cut_lineage(known.join(docs.select("doc_id"), "doc_id", "left_semi"))


def _fitted(docs: DataFrame, known: DataFrame, text: str, most_labelled: int) -> Ranking:
    """Weights from at most ``most_labelled`` rows of each class."""
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    sample = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(*order).limit(most_labelled).collect()]
    quality = {r["doc_id"]: r["quality"] for r in sample}
    if not quality:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, bool))
    chosen = docs.sparkSession.createDataFrame([(k,) for k in quality], "chosen_id long")  # at most two times most_labelled numbers
    rows = _featured(docs.select("doc_id", text).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"), "left_semi"), text)
    rows = sorted((r["doc_id"], r["x"]) for r in rows.groupBy("doc_id").agg(F.min_by("x", F.struct("text_hash", "x")).alias("x")).collect())
    values = np.array([x for _, x in rows], float).reshape(-1, N_FEATURES)
    return fit(values, np.array([quality[i] == 1 for i, _ in rows], bool), totals=(counts.get(0, 0), counts.get(1, 0)))


def _raw(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """(doc_id, raw): the weighed features of each whole text."""
    of, weights = Features(), np.array(ranking.weights)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array((of(text_bytes(batch.column(1))) * weights).sum(axis=1))], ["doc_id", "raw"])

    return map_arrow(docs.select("doc_id", text), work, "doc_id long, raw double")


def _placed(ranking: Ranking, raw: DataFrame, known: DataFrame) -> Ranking:
    """The ranking with the threshold, and the spread, over all rows of labelled documents."""
    if not any(ranking.weights):
        return ranking
    labelled = cut_lineage(raw.join(known, "doc_id"))
    n, bad, deviation = labelled.agg(F.count("*"), F.count_if(F.col("quality") == 0), F.stddev_pop("raw")).first()
    below, above = (min(max((bad + i) / n, 0.0), 1.0) for i in (0, 1))
    low, high = labelled.agg(F.percentile_approx("raw", [below, above], ACCURACY)).first()[0]  # a summary of bounded size
    return replace(ranking, threshold=(low + high) / 2, spread=max(deviation / 4, 1e-9))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", most_labelled: int = MOST_LABELLED) -> Ranking:
    """A ranking from the labelled documents that aren't held out: weights from at most ``most_labelled`` of each class, the threshold from all of them.

    A document that has both labels counts as bad; null labels and labels of unknown
    documents count for nothing. Of rows with the same doc_id the one of the smallest text hash is used for
    the weights; all of them count for the threshold. Without labels of both classes every score is 0.5.
    """
    known = _known(docs, labels)
    ranking = _fitted(docs, known, text, most_labelled)
    return _placed(ranking, _raw(docs, ranking, text), known)


def _scores(raw: DataFrame, ranking: Ranking) -> DataFrame:
    margin = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (F.col("raw") - F.lit(ranking.threshold)) / F.lit(ranking.spread)))
    return raw.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("score"))


def score(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """(doc_id, score) of each whole text. A null or empty text is scored as a text without words; repeated rows get a row each; other columns are left out."""
    return _scores(_raw(docs, ranking, text), ranking)


def good_only(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """The rows of docs that are predicted good, all columns as they are."""
    at, of = docs.columns.index(text), Features()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(ranking.scores(of(text_bytes(batch.column(at)))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by learn() on their labels; odd rows and empty tables as stated there."""
    docs = table(spark, sf_dir, "documents")
    known = _known(docs, table(spark, sf_dir, "labels"))
    ranking = _fitted(docs, known, "text", MOST_LABELLED)
    raw = cut_lineage(_raw(docs, ranking))  # texts are read once for the threshold and the scores
    found = _scores(raw, _placed(ranking, raw, known))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
