"""Substring dedup by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. To know which strings to
sort together, each string of that length gets an anchor: the leftmost of its parts of LENGTH / 2 bytes with the
smallest hash. Equal strings have equal anchors at the same place, so they meet under their anchor's hash. The strings of
one anchor form a context, a stretch of less than 1.5 LENGTH bytes. Anchors that occur once are dropped, equal contexts
are counted and meet once, and a group is the different contexts of one anchor. Groups with more than MOST
contexts are cut at the anchor's place within the string: each half shares a longer part, whose hash is its
key, and halves that are equal meet again. In the end a half is one string, so a group of any size comes down to bounded ones.

Groups are dealt to buckets of about BUCKET bytes, and the contexts of a bucket to SHARDS shards. Symbols are
the STEP bytes at each place. A shard sorts its suffixes and keeps a row for each class of suffixes
that agree in LENGTH bytes: its symbol (the first column) and the class that follows (the mapping between first column and
transform, read from first to last). Shards are merged by refining their interleave: it begins ordered by the
first symbol, and each round orders the suffixes of a block by the blocks that follow them, which adds a symbol. Only blocks in which shards are mixed are
looked at again, as a shard's own suffixes are in order already. What is still mixed after the last
round has a common prefix of LENGTH bytes: those blocks, and the classes with several strings, are the repeated intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import map_arrow, small_batches, table, text_bytes
from brindle.session import next_round, table_path

LENGTH, STEP = 400, 16
#: Different contexts of a key beyond which it is cut in two.
MOST = 512
#: Bytes of contexts that are sorted at a time, and the shards in which they are.
BUCKET, SHARDS = 1 << 20, 4
#: Bytes of texts in which anchors are searched at a time; places in them fit in PLACE bits.
CHUNK, PLACE = 1 << 19, 20
SEED = 42

PIECE = ["id0", "th", "pos", "len", "at", "a", "c1", "c2"]
PIECE_SCHEMA = "id0 long, th long, pos long, len int, at int, a long, c1 long, c2 long"


# ---- anchors ----


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, powers of an odd number modulo 2 ** 64, and those of its inverse."""
    rng = np.random.default_rng(SEED)
    base = int(rng.integers(0, 1 << 63)) * 2 + 1
    up, down = (np.cumprod(np.r_[1, np.full((1 << PLACE) - 1, x, np.uint64)].astype(np.uint64), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    return rng.integers(0, 1 << 64, 256, np.uint64), up, down


def part_hashes(t: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes at each place."""
    random, up, down = _powers()
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(random[t] * up[: len(t)], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: len(t) - width + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    so_far = np.minimum.accumulate(rows, axis=1).ravel()
    to_come = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_come[: n - width + 1], so_far[width - 1 : n])


def contexts(t: np.ndarray, text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, end, anchor, hash) of each context: strings of ``length`` bytes start at start..end - 1; ``text`` tells the text of each byte, and no string crosses texts."""
    n, part = len(t) - length + 1, length // 2
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    h = part_hashes(t, part)
    low = np.uint64((1 << PLACE) - 1)
    least = least_of_each((h & ~low) | np.arange(len(h), dtype=np.uint64), length - part + 1)
    whole = text[:n] == text[length - 1 :]
    start = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])])
    end = np.r_[start[1:], n]
    # a text's last strings are followed by some that cross into the next one
    ends = np.flatnonzero(whole & np.r_[~whole[1:], True]) + 1
    end = np.minimum(end, ends[np.minimum(np.searchsorted(ends, start, "right"), len(ends) - 1)]) if len(ends) else end
    keep = whole[start]
    start, end = start[keep], end[keep]
    at = (least[start] & low).astype(np.int64)
    return start, end, at, h[at]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _cut(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of CHUNK bytes or little more; parts of a long text overlap, so that each of its strings is in one part."""
    held, size = [], 0
    for i, x in enumerate(texts):
        if len(x) < length:
            continue
        for o in range(0, len(x) - length + 1, CHUNK):
            part = x[o : o + CHUNK + length - 1]
            if size + len(part) > CHUNK + length:
                yield held
                held, size = [], 0
            held.append((i, o, part))
            size += len(part)
    if held:
        yield held


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """A row for each context of each row of docs (id0, th, text): PIECE. at is the anchor's place in the context, a its hash, c1 and c2 a digest of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = [batch.column(i).to_numpy() for i in range(2)]
            for held in _cut(text_bytes(batch.column(2)), length):
                if not held:
                    continue
                sizes = np.array([len(x) for _, _, x in held])
                joined = b"".join(x for _, _, x in held)
                start, end, at, h = contexts(np.frombuffer(joined, np.uint8), np.repeat(np.arange(len(held)), sizes), length)
                part = np.searchsorted(np.cumsum(sizes), start, "right")
                row, offset = (np.array([x[i] for x in held], np.int64)[part] for i in range(2))
                digests = _halves([xxhash.xxh3_128_digest(joined[s:e], SEED) for s, e in zip(start.tolist(), (end + length - 1).tolist(), strict=True)])
                pos = start - (np.cumsum(sizes) - sizes)[part] + offset
                columns = [ids[0][row], ids[1][row], pos, (end - start + length - 1).astype(np.int32), (at - start).astype(np.int32), _signed(h), digests[:, 0], digests[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], PIECE)

    return docs.mapInArrow(run, PIECE_SCHEMA)


# ---- transforms and their merge ----


def _blocks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): elements in the order of their keys, and for each place of that order the first place of its block of equal keys."""
    order = np.argsort(key)
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]]
    return order, np.flatnonzero(fresh)[np.cumsum(fresh) - 1]


def _refined(block: np.ndarray, active: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(active in order, start of each one's block among them): orders the elements of whole blocks by the blocks that follow them, and gives the new blocks their first places.

    A block's number is its first place in the order of all; -1 follows at an end.
    """
    key = block[active] << 32 | follows + 1
    order, start = _blocks(key)
    active = active[order]
    old = block[active]
    first = np.r_[True, old[1:] != old[:-1]]
    block[active] = old + start - np.flatnonzero(first)[np.cumsum(first) - 1]
    return active, start


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number; zeros follow at the end."""
    padded = np.r_[t, np.zeros(7, np.uint8)].astype(np.uint64)
    words = np.zeros(len(t), np.uint64)
    for i in range(8):
        words |= padded[i : i + len(t)] << np.uint64(56 - 8 * i)
    return words


def _after(block: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    found = np.full(len(at), -1, np.int64)
    inside = at + step < len(block)
    found[inside] = block[at[inside] + step]
    return found


class Transform:
    """A shard: classes of suffixes that agree in ``length`` bytes, in order, with their symbols and the classes that follow them."""

    def __init__(self, strings: list[bytes], length: int) -> None:
        t = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        self.ends = np.cumsum(sizes)
        left = np.repeat(self.ends, sizes) - np.arange(len(t))
        self.starts_string = left >= length  # a string of that length starts here and stays within its context
        words = _words(t)
        order, start = _blocks(words)
        block = np.empty(len(t), np.int64)
        block[order] = start
        active, depth = order, 8
        while depth < length:
            step = min(depth, length - depth)
            crowd = np.bincount(block[active], minlength=len(t))
            active = active[crowd[block[active]] > 1]
            if not len(active):
                break
            active, _ = _refined(block, active, _after(block, active, step))
            depth += step
        order = np.argsort(block)
        fresh = np.r_[True, block[order[1:]] != block[order[:-1]]]
        self.of = np.empty(len(t), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        one = order[fresh]  # a suffix of each class
        self.high, self.low = words[one], np.where(one + 8 < len(t), words[np.minimum(one + 8, len(t) - 1)], 0).astype(np.uint64)
        self.follows = _after(self.of, one, STEP)
        self.strings = np.bincount(self.of, weights=self.starts_string, minlength=len(one)).astype(np.int64)


def repeated(shards: list[Transform], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard, which of its suffixes start with a string of ``length`` bytes that starts elsewhere in some shard too: the shards' interleave is refined until only such ones are mixed."""
    sizes = np.array([len(s.high) for s in shards])
    base = np.cumsum(sizes) - sizes
    shard = np.repeat(np.arange(len(shards)), sizes)
    strings = np.concatenate([s.strings for s in shards])
    follows = np.concatenate([np.where(s.follows < 0, -1, s.follows + b) for s, b in zip(shards, base, strict=True)])
    order, start = _blocks(np.concatenate([s.high for s in shards]))
    block = np.empty(len(shard), np.int64)
    block[order] = start
    second, start = _blocks(np.concatenate([s.low for s in shards]))
    low = np.empty(len(shard), np.int64)
    low[second] = start
    active, start = _refined(block, order, low[order])
    found = strings > 1
    for depth in range(STEP, length + 1, STEP):
        heads = np.flatnonzero(start == np.arange(len(start)))
        if not len(heads):
            break
        mixed = np.minimum.reduceat(shard[active], heads) != np.maximum.reduceat(shard[active], heads)
        inside = np.repeat(mixed, np.diff(np.r_[heads, len(active)]))
        active = active[inside]
        if depth == length or not len(active):
            break
        after = follows[active]
        active, start = _refined(block, active, np.where(after < 0, -1, block[after]))
    if len(active):
        heads = np.flatnonzero(np.r_[True, block[active[1:]] != block[active[:-1]]])
        total = np.add.reduceat(strings[active], heads)
        found[active] |= np.repeat(total, np.diff(np.r_[heads, len(active)])) > 1
    return [found[b : b + n][s.of] & s.starts_string for s, b, n in zip(shards, base, sizes, strict=True)]


def repeated_strings(strings: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each context, [start, end, ...]: the runs of places where a string of ``length`` bytes starts that also starts elsewhere in these contexts."""
    if length % STEP or length < 2 * STEP:
        raise ValueError(f"the length must be a multiple of {STEP}, and {2 * STEP} or more")
    dealt = [d for i in range(shards) if (d := strings[i::shards])]
    transforms = [Transform(d, length) for d in dealt]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    for i, (s, marks) in enumerate(zip(transforms, repeated(transforms, length), strict=True)):
        marks = np.r_[False, marks, False].astype(np.int8)
        turns = np.flatnonzero(np.diff(marks))  # never between strings, as none starts in a context's last bytes
        bounds = np.searchsorted(turns, np.r_[0, s.ends])
        for j, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            out[i + j * shards] = turns[a:b] - (s.ends[j - 1] if j else 0)
    return out


def _merged(strings: DataFrame, length: int) -> DataFrame:
    """(key, c1, c2, runs) of contexts (key, c1, c2, piece) with a repeated string; those of a key are in one bucket, and repeated rows count once."""
    names = ["key", "c1", "c2", "runs"]

    def solved(held: list[tuple]) -> pa.RecordBatch:
        runs = repeated_strings([x[3] for x in held], length)
        rows = [(*x[:3], r.tolist()) for x, r in zip(held, runs, strict=True) if len(r)]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in small_batches(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[:3] == last:
                    continue
                if size >= BUCKET and row[0] != last[0]:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[:3]
        if held:
            yield solved(held)

    return strings.select("key", "c1", "c2", "piece").repartition("key").sortWithinPartitions("key", "c1", "c2").mapInArrow(run, "key long, c1 long, c2 long, runs array<int>")


# ---- groups of any size ----


def _groups(pieces: DataFrame, most: int, *holder: str) -> tuple[DataFrame, DataFrame]:
    """(counted, hot) of rows (key, c1, c2, ...): different contexts with n, m (of their key) and one holder's columns; keys of more than ``most`` contexts."""
    counted = pieces.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*holder)).alias("h"))
    counted = next_round(counted.select("key", "c1", "c2", "n", "h.*"))
    sizes = next_round(counted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    return counted.join(sizes, "key", "left"), next_round(sizes.where(F.col("m") > most).select("key"))


def _found(counted: DataFrame, below: DataFrame) -> DataFrame:
    """(key, c1, c2, runs) of contexts with a repeated string; null runs: all of it, as the context itself is repeated."""
    whole = counted.where("n > 1").select("key", "c1", "c2", F.lit(None).cast("array<int>").alias("runs"))
    return whole.union(below.join(counted.where("n = 1"), ["key", "c1", "c2"], "left_semi").select("key", "c1", "c2", "runs"))


def _split(strings: DataFrame, length: int) -> DataFrame:
    """Contexts (key, c1, c2, at, lo, hi, piece) cut at the middle of their cell lo..hi - 1 of places of the anchor: (owner, o1, o2, off, key, c1, c2, at, lo, hi, piece)."""
    names = ["owner", "o1", "o2", "off", "key", "c1", "c2", "at", "lo", "hi", "piece"]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for key, c1, c2, at, lo, hi, s in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                count, middle = len(s) - length + 1, (lo + hi) // 2
                edge = min(max(at - middle + 1, 0), count)  # strings before it have their anchor at the middle or later
                for a, b, x, y in ((0, edge, middle, hi), (edge, count, lo, middle)):
                    if a < b:
                        shared = s[at - x : at - y + 1 + length]  # what all strings of the cell have
                        own = s[a : b + length - 1]
                        k = xxhash.xxh64_intdigest(shared, SEED + (x << 32) + y) - (1 << 63)
                        rows.append((key, c1, c2, a, k, *np.frombuffer(xxhash.xxh3_128_digest(own, SEED), "<i8").tolist(), at - a, x, y, own))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    given = strings.select("key", "c1", "c2", "at", "lo", "hi", "piece")
    return given.mapInArrow(run, "owner long, o1 long, o2 long, off int, key long, c1 long, c2 long, at int, lo int, hi int, piece binary")


def _runs(strings: DataFrame, hot: DataFrame, length: int, most: int) -> DataFrame:
    """(key, c1, c2, runs) of different contexts (key, c1, c2, at, lo, hi, piece) with a repeated string, those under hot keys by halves.

    A cell has a string's place of the anchor, so there are as many steps as it takes to halve length / 2 down to one, however many contexts there are.
    """
    if hot.isEmpty():
        return _merged(strings, length)
    warm = strings.join(hot, "key", "left_semi").dropDuplicates(["key", "c1", "c2"])
    halves = next_round(_split(warm, length))
    own = ["owner", "o1", "o2", "off"]
    counted, hotter = _groups(halves, most, *own)
    met = halves.join(counted.where("m > 1").select(*own), own, "left_semi")
    count = (F.octet_length("piece") - length + 1).cast("int")
    bounds = halves.select(*own, "key", "c1", "c2", count.alias("count"))
    back = bounds.join(_found(counted, _runs(met, hotter, length, most)), ["key", "c1", "c2"])
    # a half that is repeated as a whole has all of the places at which its strings start
    shifted = F.transform(F.coalesce("runs", F.array(F.lit(0), F.col("count"))), lambda x: x + F.col("off"))
    back = back.select(F.col("owner").alias("key"), F.col("o1").alias("c1"), F.col("o2").alias("c2"), shifted.alias("runs"))
    both = back.groupBy("key", "c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # of two halves
    return next_round(_merged(strings.join(hot, "key", "left_anti"), length).union(both))  # else the plans of all steps end up in one


# ---- documents ----


def _keyed(docs: DataFrame) -> DataFrame:
    """(id0, th, text) of each row, with an empty text for null; rows of one doc_id and text have the same key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id0"), F.xxhash64(text).alias("th"), text.alias("text"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, c1, c2, at, piece) of the wanted (id0, th, pos, len, key, c1, c2, at), which are cut out of their documents."""
    lists = wanted.groupBy("id0", "th").agg(F.collect_list(F.struct("key", "c1", "c2", "at", "pos", "len")).alias("list"))
    names = ["key", "c1", "c2", "at", "piece"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, texts = batch.column(1), text_bytes(batch.column(0))
        flat = lists.flatten()
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())).tolist()
        pos, size = (flat.field(i).to_pylist() for i in (4, 5))
        cut = [texts[r][p : p + n] for r, p, n in zip(row, pos, size, strict=True)]
        return pa.RecordBatch.from_arrays([flat.field(i) for i in range(4)] + [pa.array(cut, pa.binary())], names)

    met = _keyed(docs).join(lists, ["id0", "th"]).select("text", "list")
    return map_arrow(met, work, "key long, c1 long, c2 long, at int, piece binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(id0, th, spans): for each different (doc_id, text) with repeated strings, [start, end) of stretches of bytes that they cover; stretches may overlap."""
    path = table_path(docs.sparkSession, "contexts")
    _pieces(_keyed(docs), length).write.option("compression", "zstd").parquet(path)
    pieces = docs.sparkSession.read.parquet(path).withColumnRenamed("a", "key")
    again = next_round(pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))  # a written side lets the join split a hot anchor
    pieces = next_round(pieces.join(again, "key", "left_semi"))
    counted, hot = _groups(pieces, most, "id0", "th", "pos", "len", "at")
    strings = next_round(_texts(docs, counted.where("m > 1").drop("n", "m")))
    found = _found(counted, _runs(strings.withColumns({"lo": F.lit(0), "hi": F.lit(length - length // 2 + 1)}), hot, length, most))
    met = pieces.join(found, ["key", "c1", "c2"]).select("id0", "th", "pos", "len", "runs").dropDuplicates(["id0", "th", "pos"])
    return met.groupBy("id0", "th").agg(F.collect_list(F.struct("pos", "len", "runs")).alias("spans"))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of some that may overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) of every row: each byte is removed that is covered by a string of ``length`` bytes which also starts anywhere else.

    kept are the bytes that stay (a cut may fall within a character), spans the removed stretches as [start, end, ...].
    Null texts are empty. Repeated rows are copies of each other, so a text of ``length`` bytes or more that
    occurs in two rows loses all, null doc_ids included. Texts shorter than that keep all. An empty table
    gives no rows; other columns, of whatever name, are left out. ``length`` is a multiple of STEP.
    """
    spans = repeated_spans(docs, length, most)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, x, found in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            cut = covered([(s["pos"] + a, s["pos"] + b + length - 1) for s in found or () for a, b in (zip(s["runs"][::2], s["runs"][1::2], strict=True) if s["runs"] is not None else [(0, s["len"] - length + 1)])])
            edges = [0, *(e for span in cut for e in span), len(x)]
            kept = b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(x), len(x) - len(kept), len(cut), kept, edges[1:-1]))
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id0"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(keyed.join(spans, ["id0", "th"], "left").select("doc_id", "text", "spans"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """without_repeats() of all documents, with a digest of what is kept; odd rows and empty tables as stated there."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
