"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Tokens are words in lower case. The FREQUENT words that the whole corpus has most often have
classes of their own, all others are hashed to the rest of VOCABULARY classes. The network embeds the WINDOW
classes on either side of a token, adds them up through one hidden layer, and gives a softmax over
all classes. The chance of a word is that of its class times its share of the class, counted
over the whole corpus, so that the table of words grows with the corpus and a word that occurs
once is less likely than one that occurs often. A document's score is the sum over its tokens of
the log-probability given both sides.

Texts are cut into words once: a slice is a row of some documents with their words as numbers and
a dictionary of its own. Words are counted by their dictionaries, and every slice gets the
counts of its own words back, so that no table of all words is ever broadcast.

The network is trained in numpy. Documents are dealt to groups by hash, about GROUP_TOKENS tokens each, and stand in
hashed order within a group. In each round every group starts from the current weights and runs Adam over its masked
tokens, and the weights of all groups are averaged by tokens in a tree of bounded fan-in. A
token is masked in one of the rounds, by a hash of document and place. So every token is
trained on, and neither weights nor scores depend on how the input is partitioned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm._common import small_batches, table, text_bytes
from brindle.session import cut_lineage, table_path

VOCABULARY, FREQUENT, WINDOW, EMBEDDED, HIDDEN = 256, 192, 2, 12, 24
#: Share of tokens that a training round masks (each token once over all rounds), tokens in a step, rounds, step size, and seed.
MASKED, STEP, ROUNDS, RATE, SEED = 0.5, 512, 2, 6e-3, 13
#: Tokens that one group of documents is to have.
GROUP_TOKENS = 4_000_000
#: Networks that are averaged in one row.
FAN_IN = 32
#: Tokens and different words after which a slice ends; a text is never cut.
SLICE_TOKENS, SLICE_WORDS = 1 << 19, 200_000
#: Slices in a file. Spark reads up to 4096 rows of a file at once, which would be all slices of 128 MB of texts.
FILE_SLICES = 4
SLICE = "slice long, words array<binary>, ns array<long>, doc_ids array<long>, lengths array<long>, tokens binary"


class _Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def in_planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 with all their first bytes first, then all second ones: high bytes are mostly nought, and next to each other they take hardly any room once compressed."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def sliced(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of some documents: their words (bytes, ASCII letters in lower case) with counts, and each document's words as numbers, one after the other, in_planes()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, parts, n = _Numbered(), [], [], 0

        def ended() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, np.uint32), *parts])
            row = [0, list(words), np.bincount(flat, minlength=len(words)).tolist(), list(ids), [len(x) for x in parts], in_planes(flat)]
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            words.clear(), ids.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["slice", "words", "ns", "doc_ids", "lengths", "tokens"])

        for batch in small_batches(batches, 200):
            for i, t in zip(batch.column(0).cast(pa.int64()).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(i)
                parts.append(np.array(list(map(words.__getitem__, t.lower().split())), np.uint32))
                n += len(parts[-1])
                if n >= SLICE_TOKENS or len(words) >= SLICE_WORDS or len(ids) >= SLICE_WORDS:
                    yield ended()
                    n = 0
        if ids:
            yield ended()

    return docs.select("doc_id", text).mapInArrow(run, SLICE).withColumn("slice", F.monotonically_increasing_id())


def written(slices: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, so that their numbers hold and texts are cut up once; a writer or reader holds few slices at a time, however large its part of the texts is."""
    path = table_path(slices.sparkSession, "slices")
    slices.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_SLICES).parquet(path)
    return slices.sparkSession.read.parquet(path)


def _counted(slices: DataFrame) -> DataFrame:
    return slices.select(F.explode(F.arrays_zip("words", "ns")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.ns").alias("n"))


def _ledger(slices: DataFrame) -> DataFrame:
    """(slice, at, word, n, total, first) of every word of every slice: one exchange by word gives a word's total to all slices that have it, and marks one of them."""
    listed = slices.select("slice", F.posexplode(F.arrays_zip("words", "ns")).alias("at", "w")).select("slice", "at", F.col("w.words").alias("word"), F.col("w.ns").alias("n"))
    of = Window.partitionBy("word").orderBy("slice")  # one order for both, so that rows are sorted once
    whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = listed.withColumns({"total": F.sum("n").over(whole), "first": F.row_number().over(of) == 1})
    path = table_path(slices.sparkSession, "words")
    told.write.option("compression", "zstd").parquet(path)
    return slices.sparkSession.read.parquet(path)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all whole texts; words are bytes in lower case (ASCII letters only)."""
    return _counted(sliced(docs, text))


@dataclass(frozen=True)
class Words:
    """The class of each word: its place among the frequent ones, or one of the rest by CRC-32."""

    frequent: tuple[bytes, ...] = ()
    vocabulary: int = VOCABULARY

    @staticmethod
    def of(docs: DataFrame, frequent: int = FREQUENT, vocabulary: int = VOCABULARY) -> Words:
        return Words.among(word_counts(docs), frequent, vocabulary)

    @staticmethod
    def among(counts: DataFrame, frequent: int = FREQUENT, vocabulary: int = VOCABULARY) -> Words:
        top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
        return Words(tuple(bytes(r["word"]) for r in top), vocabulary)

    @property
    def rest(self) -> int:
        """Classes of words that aren't frequent."""
        return self.vocabulary - len(self.frequent)

    def classes(self, words: list[bytes]) -> np.ndarray:
        known = {w: i for i, w in enumerate(self.frequent)}
        first, rest = len(self.frequent), self.rest
        return np.array([c if (c := known.get(w)) is not None else first + zlib.crc32(w) % rest for w in words], np.int64)

    def sizes(self, counts: DataFrame) -> np.ndarray:
        """For each hashed class: its tokens, plus one for each of its words and one for what never occurs."""
        shared = F.pmod(F.crc32("word"), F.lit(self.rest)).cast("int")
        sums = counts.groupBy(shared.alias("class")).agg(F.sum(F.col("n") + 1).alias("n")).collect()  # a row for each class
        own = counts.where(F.col("word").isin([F.lit(w) for w in self.frequent])).collect() if self.frequent else []  # FREQUENT rows
        out = np.ones(self.rest)
        for r in sums:
            out[r["class"]] += r["n"]
        for r in own:
            out[zlib.crc32(bytes(r["word"])) % self.rest] -= r["n"] + 1
        return out


@dataclass
class Network:
    """Weights of the network; class ``vocabulary`` stands for places beyond either end of a text."""

    embedding: np.ndarray  # (vocabulary + 1, embedded)
    inner: np.ndarray  # (2 * window * embedded, hidden)
    inner_bias: np.ndarray
    outer: np.ndarray  # (hidden, vocabulary)
    outer_bias: np.ndarray

    @staticmethod
    def fresh(vocabulary: int = VOCABULARY, window: int = WINDOW, embedded: int = EMBEDDED, hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        return Network(rng.normal(size=(vocabulary + 1, embedded)).astype(np.float32) * 0.3, small(2 * window * embedded, hidden), np.zeros(hidden, np.float32), small(hidden, vocabulary) * 0.1, np.zeros(vocabulary, np.float32))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.inner, self.inner_bias, self.outer, self.outer_bias]

    @property
    def vocabulary(self) -> int:
        return self.outer.shape[1]

    @property
    def window(self) -> int:
        return self.inner.shape[0] // self.embedding.shape[1] // 2

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for w in self.weights:
            out.append(flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return Network(*out)

    def placed(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(padded, places): all documents in a row with edges between them, and where their tokens stand."""
        w, edge = self.window, np.full(self.window, self.vocabulary, np.int64)
        padded = np.concatenate([edge, *[x for d in docs for x in (d, edge)]])
        starts = w + np.cumsum([0, *[len(d) + w for d in docs]])
        return padded, np.concatenate([np.zeros(0, np.int64), *[np.arange(len(d)) + at for d, at in zip(docs, starts, strict=False)]])

    def around(self, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The classes before and after each place."""
        return padded[places[:, None] + np.r_[np.arange(-self.window, 0), np.arange(1, self.window + 1)]]

    def contexts(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(targets, contexts) of all tokens."""
        padded, places = self.placed(docs)
        return padded[places], self.around(padded, places)

    def forward(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, hidden layer, log-probabilities of all classes)."""
        x = self.embedding[contexts].reshape(len(contexts), -1)
        h = np.tanh(x @ self.inner + self.inner_bias)
        z = h @ self.outer + self.outer_bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return x, h, z

    def log_probabilities(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The log-probability of the class of each token of each document."""
        padded, places = self.placed(docs)
        tall, parts, outer = self.tall, [], self.with_bias
        ones = np.ones(self.vocabulary, outer.dtype)
        for s in range(0, len(places), 1024):  # contexts of few tokens exist at a time, however long a text is
            at = places[s : s + 1024]
            z = self.hidden(self.embedding[self.around(padded, at)].reshape(len(at), -1)) @ outer
            if tall:
                z -= z.max(axis=1, keepdims=True)
            own = z.ravel()[np.arange(len(at)) * self.vocabulary + padded[at]]
            parts.append(own - np.log(np.exp(z, out=z) @ ones))
        flat = np.concatenate([np.zeros(0), *parts])
        return np.split(flat, np.cumsum([len(d) for d in docs])[:-1]) if docs else []

    @property
    def with_bias(self) -> np.ndarray:
        """The outer weights with their bias as a last row."""
        return np.vstack([self.outer, self.outer_bias])

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """The hidden layer of some inputs, with a last column of ones."""
        h = np.ones((len(x), self.inner.shape[1] + 1), x.dtype)
        np.tanh(x @ self.inner + self.inner_bias, out=h[:, :-1])
        return h

    def gradients(self, targets: np.ndarray, contexts: np.ndarray) -> list[np.ndarray]:
        n, embedded = len(targets), self.embedding.shape[1]
        x = self.embedding[contexts].reshape(n, -1)
        h = self.hidden(x)
        d = h @ self.with_bias
        if self.tall:
            d -= d.max(axis=1, keepdims=True)
        np.exp(d, out=d)
        # rows aren't divided by their sums, which the narrow sides of the products take instead
        sums = d @ np.ones(self.vocabulary, d.dtype)
        d.ravel()[np.arange(n) * self.vocabulary + targets] -= sums
        share = (1 / (sums * n))[:, None]
        outer = (h * share).T @ d
        h = h[:, :-1]
        dh = (d @ self.outer.T) * share * (1 - h * h)
        dx = dh @ self.inner.T
        at = (contexts.ravel() * embedded)[:, None] + np.arange(embedded)
        de = np.bincount(at.ravel(), dx.ravel(), self.embedding.size).reshape(self.embedding.shape).astype(self.embedding.dtype)
        return [de, x.T @ dh, dh.sum(axis=0), outer[:-1], outer[-1]]

    @property
    def tall(self) -> bool:
        """Whether an exponential could overflow."""
        return bool(np.abs(self.outer).sum(axis=0).max(initial=0) + np.abs(self.outer_bias).max(initial=0) > 60)


class Adam:
    def __init__(self, network: Network, rate: float = RATE) -> None:
        self.network, self.rate, self.t = network, rate, 0
        self.mean = [np.zeros_like(w) for w in network.weights]
        self.square = [np.zeros_like(w) for w in network.weights]

    def step(self, targets: np.ndarray, contexts: np.ndarray) -> None:
        self.t += 1
        for w, g, m, v in zip(self.network.weights, self.network.gradients(targets, contexts), self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that the Python objects of one slice exist at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _dealt(slices: DataFrame, words: Words, groups: int) -> DataFrame:
    """(part, place, classes): documents with words by group, in their hashed order; a group's documents stand in one task, in an order that rows alone decide. Written once for all rounds, in the same partitions."""
    shared = slices.sparkSession.sparkContext.broadcast(words)  # FREQUENT words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            of = shared.value.classes(row["words"]).astype(np.uint16)
            flat = of[from_planes(row["tokens"])] if len(of) else np.zeros(0, np.uint16)
            ends = np.cumsum([0, *row["lengths"]]).astype(np.int32) * 2
            classes = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), classes], ["doc_id", "classes"])

    docs = slices.select("words", "doc_ids", "lengths", "tokens").mapInArrow(run, "doc_id long, classes binary").where(F.octet_length("classes") > 0).withColumn("place", F.xxhash64(F.lit(SEED), "doc_id", "classes"))
    dealt = docs.select(F.pmod("place", F.lit(groups)).alias("part"), "place", "classes")
    return cut_lineage(dealt.repartition("part").sortWithinPartitions("part", "place", "classes"))


def chosen(place: int, n: int, round_: int, masked: float) -> np.ndarray:
    """Which of a document's n tokens are masked in a round: over 1 / masked rounds each of them once."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(place & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 + round_ * masked) % 1.0 < masked


def _train(dealt: DataFrame, start: Network, round_: int, masked: float) -> DataFrame:
    """(part, tokens, weights) of the network that each group arrives at."""
    shared = dealt.sparkSession.sparkContext.broadcast(start)  # one network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, adam, seen = None, None, None, 0
        targets, contexts, n = [], [], 0

        def learn(least: int) -> None:
            nonlocal targets, contexts, n, seen
            t, c = np.concatenate(targets), np.concatenate(contexts)
            while n >= max(least, 1):
                adam.step(t[:STEP], c[:STEP])
                seen += len(t[:STEP])
                t, c = t[STEP:], c[STEP:]
                n = len(t)
            targets, contexts = [t], [c]

        def ended() -> Iterator[pa.RecordBatch]:
            if n:
                learn(1)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([adam.network.flat().tobytes()], pa.binary())], ["part", "tokens", "weights"])

        for batch in small_batches(batches):
            for group, place, classes in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if group != part:
                    yield from ended()
                    part, last, adam, seen = group, None, Adam(shared.value.filled(shared.value.flat())), 0
                    targets, contexts, n = [], [], 0
                if (place, classes) == last:
                    continue
                last = place, classes
                padded, places = adam.network.placed([np.frombuffer(classes, np.uint16).astype(np.int64)])
                places = places[chosen(place, len(places), round_, masked)]
                for s in range(0, len(places), 1 << 16):
                    at = places[s : s + (1 << 16)]
                    targets.append(padded[at])
                    contexts.append(adam.network.around(padded, at))
                    n += len(at)
                    if n >= 1 << 13:
                        learn(STEP)
        yield from ended()

    return dealt.mapInArrow(run, "part long, tokens long, weights binary")


def _averaged(networks: DataFrame) -> DataFrame:
    """Networks averaged by tokens, those of FAN_IN numbers that follow each other at a time, until one is left."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                total, tokens = None, 0
                for n, w in zip(r["ns"], r["ws"], strict=True):
                    x = np.frombuffer(w, np.float32).astype(np.float64) * n
                    total, tokens = (x if total is None else total + x), tokens + n
                out.append((r["part"], tokens, (total / tokens).astype(np.float32).tobytes()))
            part, tokens, weights = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(tokens, pa.int64()), pa.array(weights, pa.binary())], ["part", "tokens", "weights"])

    ranked = cut_lineage(networks)
    while ranked.count() > 1:
        up = F.floor(F.col("part") / FAN_IN).cast("long")
        gathered = ranked.groupBy(up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("part", "tokens", "weights"))).alias("all"))  # at most FAN_IN a row
        gathered = gathered.select(F.col("up").alias("part"), F.col("all.tokens").alias("ns"), F.col("all.weights").alias("ws"))
        ranked = cut_lineage(gathered.mapInArrow(mean, "part long, tokens long, weights binary"))
    return ranked


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS, masked: float = MASKED, start: Network | None = None) -> Network:
    """A network trained on masked tokens of all whole texts; without a word in any it is the untrained one.

    Rows that repeat a doc_id and text are trained on once. The result doesn't depend on how the input is partitioned.
    """
    return _trained(sliced(docs), words, rounds, masked, start)


def _trained(slices: DataFrame, words: Words, rounds: int = ROUNDS, masked: float = MASKED, start: Network | None = None) -> Network:
    network = start or Network.fresh()
    tokens = slices.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // 4
    dealt = _dealt(slices, words, max(1, -(-tokens // GROUP_TOKENS)))
    for i in range(rounds):
        best = _averaged(_train(dealt, network, i, masked)).collect()  # one row
        if best:
            network = network.filled(np.frombuffer(best[0]["weights"], np.float32))
    return network


def score(docs: DataFrame, words: Words, network: Network, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_probability, per_token) of each whole text; ``counts`` are (word, n) of the corpus, by default of docs.

    A null or blank text has no tokens, sum 0 and a null mean. A word that the counts lack is as likely as one that occurs
    nought times with all counts raised by one. Repeated rows get a row each; an empty table gives none; other columns are left out.
    """
    slices = written(sliced(docs))
    ledger = _ledger(slices)
    if counts is None:
        counts = _totals(ledger)
    else:
        told = ledger.select("slice", "at", "word", "n").join(counts.select("word", F.col("n").alias("total")), "word", "left")
        ledger = told.withColumn("total", F.coalesce("total", F.lit(0)))
    return _scored(slices, words, network, words.sizes(counts), ledger)


def _totals(ledger: DataFrame) -> DataFrame:
    """(word, n) of the corpus."""
    return ledger.where("first").select("word", F.col("total").alias("n"))


def _scored(slices: DataFrame, words: Words, network: Network, sizes: np.ndarray, ledger: DataFrame) -> DataFrame:
    """Scores of all documents of the slices. A slice gets the totals of those of its words that other slices have as well; what only it has, it has counted itself."""
    shared = slices.sparkSession.sparkContext.broadcast((words, network, sizes))  # FREQUENT words and one network
    told = ledger.where("total <> n").select("slice", "at", "total")
    whole = slices.select("slice", "words", "ns", "doc_ids", "lengths", "tokens")

    def run(one: pa.Table, told: pa.Table) -> pa.Table:
        """The scores of a slice; told are the words that other slices have too."""
        words, network, sizes = shared.value
        first = len(words.frequent)
        part = {c: one.column(c).combine_chunks() for c in ("words", "ns", "doc_ids", "lengths")}
        part = {c: x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for c, x in part.items()}
        of = words.classes(part["words"].to_pylist())
        totals = part["ns"].to_numpy(zero_copy_only=False).astype(np.int64)
        totals[told.column("at").to_numpy()] = told.column("total").to_numpy()
        share, rare = np.zeros(len(of)), of >= first
        share[rare] = np.log((totals[rare] + 1) / sizes[of[rare] - first])
        lengths = part["lengths"].to_numpy(zero_copy_only=False)
        docs = np.split(from_planes(one.column("tokens")[0].as_py()), np.cumsum(lengths)[:-1])
        sums = []
        for s in range(0, len(docs), 200):
            some = docs[s : s + 200]
            sums += [float(p.sum(dtype=np.float64) + share[d].sum()) for p, d in zip(network.log_probabilities([of[d] for d in some]), some, strict=True)]
        means = [s / len(d) if len(d) else None for s, d in zip(sums, docs, strict=True)]
        return pa.table([part["doc_ids"], pa.array(lengths, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], ["doc_id", "n_tokens", "log_probability", "per_token"])

    # a slice and its totals meet as sorted rows: collected in the JVM, the totals of all slices of a task would stand in its memory
    return whole.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, "doc_id long, n_tokens long, log_probability double, per_token double")


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a network and counts of the same documents; odd rows and empty tables as stated there."""
    slices = written(sliced(table(spark, sf_dir, "documents")))
    ledger = _ledger(slices)
    counts = _totals(ledger)
    words = Words.among(counts)
    return _scored(slices, words, _trained(slices, words), words.sizes(counts), ledger)
