"""SimHash near-dedup of five-word shingles: long fingerprints, softly decoded to Golay codewords, and exact Jaccard similarity.

This is the method of simhash.py with the parameters that a stage on word shingles takes. A text's different shingles
give a fingerprint of 23 bits for each of 2 * TABLES segments, and for each bit how far its count is from
even. A segment is decoded to the codewords near it: the CHASE least certain bits are flipped in
all ways, each word is decoded, and codewords are ordered by the certainty of the bits that they change.
The index of the nearest codewords of two segments is the key under which a text is stored in
a table; it asks for its PROBES likeliest pairs of codewords. Texts with the same set meet in
one row. Keys that more than HOT sets are stored under are crowded; sets that crowded keys bring together, over others if need be,
have one home, and are compared in blocks of a home: the correlation of two sets' margins tells their similarity to within about 0.015, and
pairs of a block that may be similar, and haven't been joined by others of the block, are compared in full, so that a block gives a row for each set that it joins and none for each pair.
Other sets that meet under a key, whose sizes allow the similarity, and whose first 64 bits are within FAR bits, are
candidates, at most HOT for each key that is asked for, and both sets are compared in full. Of pairs at a similarity of exactly 0.8 the tables lose about one in a hundred
(tests/llm/test_near_copies_recall.py), of more similar ones fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._common import block_pairs, each_block, join_measured, map_arrow, small_batches, text_bytes
from brindle.llm.simhash import first_of_each_group, golay
from brindle.operators.components import connected_components
from brindle.session import cut_lineage, next_round, table_path

WIDTH, LEAST = 5, 0.8
TABLES, PROBES, CHASE, SEED = 12, 8, 5, 42
#: Sets stored under a key beyond which it is crowded; sets of a home, and shingles, that a block holds on either side.
HOT, BLOCK, BLOCK_SHINGLES = 8, 512, 1 << 20
#: What an estimated similarity may be below the true one (over five deviations at 0.8).
SLACK = 0.08
#: Sets with a home that are broadcast.
MOST_HOMES = 500_000
#: Bits in which the first 64 of two sets at the least similarity don't differ (10 are expected, with a deviation of 3).
FAR = 25
BITS = 23 * 2 * TABLES
WORDS = -(-BITS // 64)
CHUNK = 1 << 12  # shingles whose bits are counted at a time
MOST_WORDS = 200_000  # words whose hashes a task keeps
DECODED = 64  # texts that are decoded at a time

_rng = np.random.default_rng(SEED)
_odd = lambda n: _rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)
PLACES, FLIPS = _odd(WIDTH), _odd(WORDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of shingle hashes; the hashes of words are kept from text to text."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        """The different hashes in order; a text of fewer than WIDTH words is one shingle, and one without words has none."""
        words = text.lower().split()  # both of ASCII only
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        for w in set(words):
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w, SEED)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n, width = len(words), min(WIDTH, len(words))
        if not n:
            return hashes
        sums = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            sums += hashes[i : n - width + 1 + i] * PLACES[i]
        return np.unique(_mixed(sums))


def copy_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63) if len(shingles) else 0


def margins(shingles: np.ndarray) -> np.ndarray:
    """BITS signed bytes: how far the count of each bit over a set is from even, in 32nds of its deviation."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(shingles), CHUNK):
        words = _mixed(shingles[i : i + CHUNK, None] ^ FLIPS)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    z = (2 * ones - len(shingles)) / np.sqrt(max(len(shingles), 1))
    return np.clip(np.rint(z * 32), -127, 127).astype(np.int8)[:BITS]


def codewords(m: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each row of 23 margins the indices of the nearest codewords, and their costs: the certainty of the bits that they change."""
    code, sure = golay(), np.abs(m).astype(np.int64)
    hard = (m > 0) @ (1 << np.arange(23))
    doubtful = np.argsort(sure, axis=1, kind="stable")[:, :CHASE]
    ways = (np.arange(1 << CHASE)[:, None] >> np.arange(CHASE) & 1).T
    words = hard[:, None] ^ ((1 << doubtful) @ ways)
    found = np.sort(words ^ code.error[code.syndrome(words)], axis=1)
    changed = (found ^ hard[:, None])[:, :, None] >> np.arange(23) & 1
    cost = (changed * sure[:, None, :]).sum(axis=2)
    cost[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 20  # the same codeword again
    order = np.argsort(cost, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(found, order, 1) >> 11, np.take_along_axis(cost, order, 1)


def golay_keys(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stored, asked): a key for each text and table, and PROBES keys for each text and table, of rows of BITS margins."""
    index, cost = codewords(m.reshape(-1, 23))
    index, cost = (x.reshape(len(m), TABLES, 2, -1) for x in (index, cost))
    ways = np.array(list(product(range(index.shape[3]), repeat=2)))
    both = index[:, :, 0, ways[:, 0]] << 12 | index[:, :, 1, ways[:, 1]]
    total = cost[:, :, 0, ways[:, 0]] + cost[:, :, 1, ways[:, 1]]
    near = np.take_along_axis(both, np.argsort(total, axis=2, kind="stable")[:, :, :PROBES], 2)
    table = np.arange(TABLES) << 24
    return both[:, :, 0] | table, near | table[:, None]


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, copy, n, fp, margins) of each text: fp are the first 64 bits of its fingerprint; the empty set has neither."""
    shingles = Shingles()
    names = ["doc_id", "text_hash", "copy", "n", "fp", "margins"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in text_bytes(batch.column(2))]
        certain = [margins(x) if len(x) else None for x in sets]
        fps = [None if m is None else int(np.packbits(m[:64] > 0, bitorder="little").view("<i8")[0]) for m in certain]
        columns = [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([copy_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.int64()), pa.array([None if m is None else m.tobytes() for m in certain], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return map_arrow(hashed, work, "doc_id long, text_hash long, copy long, n long, fp long, margins binary")


def _keyed(nodes: DataFrame, asks: bool) -> DataFrame:
    """(key, copy) of nodes (copy, margins): the keys under which a set is stored, or those that it asks for."""
    names = ["key", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, DECODED):
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, BITS)
            if not len(m):
                continue
            keys = golay_keys(m)[asks].reshape(len(m), -1)
            rows = pa.array(np.repeat(np.arange(len(m)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), batch.column(0).take(rows)], names)

    return nodes.where("margins is not null").select("copy", "margins").mapInArrow(run, "key int, copy long")


def _sets(docs: DataFrame) -> DataFrame:
    """(copy, shingles): each different set once, as bytes."""
    shingles = Shingles()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in text_bytes(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array([copy_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["copy", "shingles"])

    return map_arrow(docs.select("text"), work, "copy long, shingles binary").dropDuplicates(["copy"])


def _met(left: DataFrame, right: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b, each once: sets (key, copy, root) of different roots that meet under a key, whose sizes allow the similarity, and whose fingerprints are near.

    Rows of keys carry no more than needed to leave out pairs of one root; facts (copy, n, fp) are fetched for the pairs that are left.
    """
    one, two = left.toDF("key", "a", "ra"), right.toDF("key", "b", "rb")
    met = one.join(two, "key").where(F.col("ra") != F.col("rb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = met.join(facts.toDF("a", "na", "fa"), "a").join(facts.toDF("b", "nb", "fb"), "b")
    fair = (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= FAR
    return both.where(fair & near).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                similar.append(shared >= least * (len(p) + len(q) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def crowded_from(sets: int) -> int:
    """The sets beyond which a key is crowded: HOT, and more where so many sets share the 24 bits of a table's keys that they meet by chance."""
    return HOT + 10 * (sets >> 24)


def _homes(stored: DataFrame, asked: DataFrame, crowded: DataFrame) -> DataFrame:
    """(copy, root) of the sets that are stored under a crowded key or ask for one: root is the smallest set that crowded keys lead to."""
    under = next_round(join_measured(stored.union(asked), crowded, "key", "left_semi").distinct())
    hubs = under.groupBy("key").agg(F.min("copy").alias("hub"))
    found = connected_components(under.join(hubs, "key"), "copy", "hub")
    return next_round(found.select(F.col("node").alias("copy"), F.col("component").alias("root")))


def joining(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a row of one and a later row of two that are as similar as that, only as many as join the sets that all such pairs join."""
    n = np.array([len(x) for x in sets], np.float64)
    m = np.array([margins(x) for x in sets], np.float32).reshape(-1, BITS)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1)
    label, found, others, sizes = np.arange(len(sets)), [], m[two], n[two]
    for i in one.tolist():
        shared = np.maximum(others @ m[i], 0) * np.sqrt(n[i] * sizes)
        fair = (sizes >= n[i] * least - 1e-9) & (n[i] >= sizes * least - 1e-9)
        near = two[fair & (shared >= (least - SLACK) * (n[i] + sizes - shared)) & (label[two] != label[i]) & (two > i)]
        if not len(near):
            continue
        flat = np.concatenate([sets[j] for j in near])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        same = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum([0, *n[near[:-1]].astype(np.int64)]))
        for j in near[same >= least * (n[i] + n[near] - same) - 1e-9].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def _block_links(homes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): similar sets of one home, as many as join those that are joined within a block."""
    rows = homes.join(sets, "copy").select(F.col("root").alias("key"), "copy", "shingles")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles") / 8).alias("all"))
    chunks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")
    hot = cut_lineage(sizes.select("key", chunks.alias("chunks")).where("chunks > 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_block(batches):
            copies, sets = t["copy"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
            lo = t["lo"][0].as_py()
            left = t["chunk"].to_numpy() == lo
            order = np.argsort(~left, kind="stable")  # those of lo first, so that the others are later
            sets, first = [sets[i] for i in order], int(left.sum())
            one = np.arange(first)
            two = one if lo == t["hi"][0].as_py() else np.arange(first, len(sets))
            found = np.array(joining(sets, one, two, least), np.int64).reshape(-1, 2)
            ends = np.sort(copies[order[found]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return block_pairs(rows, hot, "copy", "copy", "shingles").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, text_hash, copy, root, component_id) of every row."""
    spark, path = docs.sparkSession, table_path(docs.sparkSession, "signed")
    _signed(docs).write.option("compression", "zstd").parquet(path)
    signed = spark.read.parquet(path)
    few = cut_lineage(signed.groupBy("copy").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash")).alias("any")))
    facts = cut_lineage(signed.where("fp is not null").select("copy", "n", "fp").dropDuplicates(["copy"]))
    nodes = cut_lineage(signed.groupBy("copy").agg(F.first("margins").alias("margins")))
    stored, asked = (next_round(_keyed(nodes, asks)) for asks in (False, True))  # written, as both are read twice
    crowded = cut_lineage(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded_from(facts.count())).select("key"))
    homes = _homes(stored, asked, crowded)

    def rooted(df: DataFrame) -> DataFrame:
        return join_measured(df, homes, "copy", "left", MOST_HOMES).select("key", "copy", F.coalesce("root", "copy").alias("root"))

    pairs = next_round(_met(rooted(join_measured(stored, crowded, "key", "left_anti")), rooted(asked), facts, least))
    # one text of each set that is compared is looked at
    compared = pairs.select(F.col("a").alias("copy")).union(pairs.select("b")).union(homes.select("copy")).distinct()
    wanted = few.join(compared, "copy").select(F.col("any.col1").alias("key_id"), F.col("any.col2").alias("key_null"), F.col("any.text_hash").alias("key_hash"))
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_hash"), "text")
    sets = cut_lineage(_sets(texts.join(wanted, ["key_id", "key_null", "key_hash"], "left_semi")))
    linked = verified(pairs, sets, least).union(_block_links(homes, sets, least))
    roots = connected_components(linked, "a", "b").select(F.col("node").alias("copy"), F.col("component").alias("root"))
    placed = few.select("copy", "first").join(roots, "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return signed.select("doc_id", "text_hash", "copy").join(placed.join(smallest, "root").select("copy", "root", "component_id"), "copy")


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, copy, component_id): component_id is the smallest doc_id reachable over pairs that are as similar as ``least``.

    Null and blank texts are copies of each other. A null doc_id takes part, but is nobody's
    component_id unless all of its group are null. Repeated rows get a row each. An empty
    table gives no rows; other columns are left out.
    """
    return _grouped(docs, least).select("doc_id", "copy", "component_id")


def one_of_each_group(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each group of near copies, as simhash.first_of_each_group keeps them; also of ids that are null or repeated."""
    return first_of_each_group(docs, _grouped(docs, least))
