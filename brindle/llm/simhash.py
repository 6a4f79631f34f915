"""SimHash near-dedup with Golay-code fuzzy hashing.

Two 64-bit fingerprints within 3 bits agree on one of four 16-bit blocks (pigeonhole),
and one of the two 24-bit halves of the remaining 48 bits has an error at most. The
first 23 bits of a half are decoded to the index of the nearest codeword of the perfect
(23, 12) Golay code. A fingerprint is stored under its own index, and asks for its own
and for those of its half with one clear bit set: of two halves that differ in one
bit, the one with the bit clear finds the other. Block, half, the block's bits and the
index are the join key; the distance is verified in the join. Under a key with many
fingerprints they are compared in blocks, which give one row per fingerprint with the smallest
that it reaches, and never a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm._common import block_pairs, each_block, join_measured, labels_within, map_arrow, small_batches, table, text_bytes
from brindle.operators.components import connected_components
from brindle.session import cut_lineage, next_round

SEED, MOST_BITS = 42, 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
CHUNK = 1 << 14  # shingles whose bits are counted at a time
#: Fingerprints stored under a key beyond which they are compared in blocks, and the fingerprints of a block.
HOT, BLOCK = 32, 512


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash over word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # both of ASCII only
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _remainders() -> list[np.ndarray]:
    """Remainder modulo the generator of each byte at bits 0, 8 and 16."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    return [np.array([remainder(v << s) if v << s < 1 << 23 else 0 for v in range(256)], np.int64) for s in (0, 8, 16)]


class Golay:
    """Nearest codewords of 23-bit words; every word is within 3 bits of exactly one."""

    def __init__(self) -> None:
        self.low, self.mid, self.high = _remainders()
        self.error = np.zeros(2048, np.int64)
        singles = [1 << i for i in range(23)]
        patterns = [0, *singles]
        patterns += [a | b for i, a in enumerate(singles) for b in singles[:i]]
        patterns += [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]]
        self.error[self.syndrome(np.array(patterns))] = patterns

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 255] ^ self.mid[words >> 8 & 255] ^ self.high[words >> 16]

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 message bits of the nearest codeword."""
        return (words ^ self.error[self.syndrome(words)]) >> 11


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def parts(fps: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each block and half: its number, the block's 16 bits, and the half's first 23 bits."""
    blocks = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    out = []
    for i in range(4):
        a, b, c = (blocks[j] for j in range(4) if j != i)
        rest = a | b << 16 | c << 32
        out += [(2 * i + h, blocks[i], rest >> 24 * h & 0x7FFFFF) for h in range(2)]
    return out


def stored_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): one key for each block and half."""
    keys = [n << 28 | exact << 12 | golay().index(half) for n, exact, half in parts(fps)]
    return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys)


def asked_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys under which fingerprints with no or one bit more in a half are stored, each once."""
    rows, keys = [], []
    own = np.arange(len(fps))
    for n, exact, half in parts(fps):
        near = np.stack([half, *[half | 1 << b for b in range(23)]])  # a bit that is set gives the half itself again
        near = np.sort(golay().index(near), axis=0)
        fresh = np.ones(near.shape, bool)
        fresh[1:] = near[1:] != near[:-1]
        rows.append(np.broadcast_to(own, near.shape)[fresh])
        keys.append((n << 28 | exact << 12 | near)[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, name: str, make) -> DataFrame:
    def run(batches):
        for batch in small_batches(batches, 5000):
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = make(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[rows], pa.int64())], ["key", name])

    return nodes.select("fp").mapInArrow(run, f"key long, {name} long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: str | None = None) -> DataFrame:
    """(doc_id, fp) and a further column of longs: fp is the fingerprint as a signed long; a null text has fingerprint 0."""
    names = ["doc_id", "fp", *[extra] * (extra is not None)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64()), *batch.columns[2:]], names)

    return map_arrow(docs.select(key, text, *names[2:]), work, ", ".join(f"{n} long" for n in names))


def links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints in ``fp`` (each once) within so many bits, at most 3."""
    if not 0 <= most_bits <= 3:
        raise ValueError("the keys find pairs within 3 bits")
    stored, asked = _keyed(nodes, "a", stored_keys), _keyed(nodes, "b", asked_keys)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = stored.join(asked, "key").where((near <= most_bits) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_labels(blocks: DataFrame, most_bits: int) -> DataFrame:
    """(a, b): fingerprints of a block with the smallest that they reach within it."""

    def run(batches):
        for t in each_block(batches):
            fps, left = t["fp"].to_numpy(), t["chunk"].to_numpy() == t["lo"][0].as_py()
            cross = t["lo"][0].as_py() != t["hi"][0].as_py()
            one, two = (np.flatnonzero(left), np.flatnonzero(~left)) if cross else (np.arange(len(fps)),) * 2
            bits = fps.view(np.uint64)
            near = np.bitwise_count(bits[one][:, None] ^ bits[two][None, :]) <= most_bits
            i, j = np.nonzero(near if cross else np.triu(near, 1))
            label = labels_within(len(fps), one[i], two[j], fps)
            rows = np.flatnonzero(label != fps)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(label[rows])], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def reaching(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): pairs over which the same fingerprints reach each other as over links(), without a row for every pair of a dense group."""
    if not 0 <= most_bits <= 3:
        raise ValueError("the keys find pairs within 3 bits")
    # written, as both are read again where keys are crowded
    stored, asked = (next_round(_keyed(nodes, "fp", make)) for make in (stored_keys, asked_keys))
    crowded = cut_lineage(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = join_measured(stored, crowded, "key", "left_anti").withColumnRenamed("fp", "a")
    pairs = few.join(asked.withColumnRenamed("fp", "b"), "key").where((near <= most_bits) & (F.col("a") != F.col("b")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if crowded.isEmpty():
        return pairs
    many = join_measured(stored.union(asked), crowded, "key", "left_semi").distinct()
    sizes = many.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = cut_lineage(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")))
    return pairs.union(_block_labels(block_pairs(many, hot, "fp", "fp"), most_bits).distinct())


def _grouped(docs: DataFrame, most_bits: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row."""
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    fps = cut_lineage(fingerprints(hashed, extra="text_hash"))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(reaching(nodes, most_bits), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Copies meet in one fingerprint before any pair is made; links join fingerprints.
    Null and blank texts have fingerprint 0 and link like any other. A null doc_id takes part,
    but is nobody's component_id unless all of its group are null. Repeated rows
    get a row each. An empty table gives no rows; other columns are left out.
    """
    return _grouped(docs, most_bits).select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each root in ``groups`` (doc_id, text_hash, root): that of the smallest doc_id (null last), then of the smallest text hash.

    So a group keeps one text even where ids are null or repeated with other texts. Rows that are equal in doc_id and
    text count as one document; of those the one of the smallest hash over all columns stays. All columns stay as they are.
    """
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    kept = groups.groupBy("root").agg(F.min(own).alias("k")).select(F.coalesce("k.doc_id", F.lit(0)).alias("key_id"), F.col("k.nameless").alias("key_null"), F.col("k.text_hash").alias("key_hash"))
    row = F.struct("*").alias("document")
    named = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_hash"), row)
    keys = ["key_id", "key_null", "key_hash"]
    # the join has dealt the rows by these keys already, so the window needs no further exchange
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("document")))
    return named.join(kept, keys, "left_semi").withColumn("place", first).where("place = 1").select("document.*")


def one_of_each_group(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One document of each group, as first_of_each_group keeps them."""
    return first_of_each_group(docs, _grouped(docs, most_bits))


def op9_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents with fingerprints in hexadecimal; odd rows and empty tables as stated there."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
