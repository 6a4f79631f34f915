"""Shards by a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..N-1 are permuted by a Feistel network on pairs of digits to the
base m = ceil(sqrt(N)), so its domain m*m exceeds N by less than 2m+1; a number
that falls outside is permuted again until it lies inside (cycle walking). The
position alone then gives shard = position mod n and slot = position div n:
counts differ by one at most, and anyone who knows N and the seed can compute
where a row is, or which row is at a place. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm._common import join_measured, table
from brindle.session import cut_lineage

PRIME = 2**31 - 1
SHARDS, SEED, ROUNDS = 16, 20240607, 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """An addend and two multipliers below PRIME for each round, from SHA-256 of the seed."""
    keys = []
    for i in range(rounds):
        digest = hashlib.sha256(f"feistel:{seed}:{i}".encode()).digest()
        keys.append(tuple(1 + int.from_bytes(digest[8 * j : 8 * j + 8], "big") % (PRIME - 1) for j in range(3)))
    return keys


def base_of(n: int) -> int:
    """The smallest m with m * m >= n."""
    return isqrt(max(n - 1, 0)) + 1


def walk_bound(n: int) -> int:
    """Walks that suffice: all numbers outside, or 64, which then fails with a chance below 1e-70."""
    return max(1, min(base_of(n) ** 2 - n, 64))


def whole(x: Column, by: int) -> Column:
    """Integer division of numbers from 0, without passing through a double."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def permuted(number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The position of a row number under the permutation of 0..n-1 that the seed names."""
    m = base_of(n)
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(k, "abc", strict=True)]) for k in round_keys(seed, rounds)])

    def mixed(r: Column, key: Column) -> Column:
        x = (r + key["a"]) % PRIME * key["b"] % PRIME
        return x.bitwiseXOR(F.shiftright(x, 16)) % PRIME * key["c"] % PRIME % m

    def once(x: Column) -> Column:
        start = F.struct(whole(x, m).alias("l"), (x % m).alias("r"))
        return F.aggregate(keys, start, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + mixed(s["r"], k)) % m).alias("r")), lambda s: s["l"] * m + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walk_bound(n))), once(number.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking didn't end")).cast("long"))


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with a gapless ``row`` in the given order, count), without one task that sees all rows.

    Rows are dealt by ranges of the order, ties included (rows that tie in every
    column of the order get consecutive numbers, which of them first is open), numbered
    within a range, and shifted by the count of the ranges before. Ranges come from
    a sample, so the dealt rows are checkpointed before they are counted.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*keys, F.col("__tie")).sortWithinPartitions(*keys, F.col("__tie")).drop("__tie")
    dealt = cut_lineage(dealt.withColumns({"__part": F.spark_partition_id(), "__index": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row per partition: the only thing that one task gets whole
    before = counts.select("__part", F.expr("sum(__n) over (order by __part) - __n").alias("__before"))
    before = cut_lineage(before)
    n = dealt.count()
    numbered = join_measured(dealt, before, "__part", "inner").withColumn("row", F.col("__before") + F.col("__index"))
    return numbered.drop("__part", "__index", "__before", "__n"), n


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its size, CRC-32, row number, position, shard and slot.

    A null text counts as empty (size 1, CRC-32 0). Rows are numbered by key
    (nulls first), CRC-32 and size; repeated rows are rows of their own. Equal texts
    aren't kept together. An empty table gives no rows. ``carry`` names columns
    to take along; all others, whatever their names, are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    numbered, n = row_numbers(slim, ["doc_id", "text_crc32", "size"])
    position = permuted(F.col("row"), n, seed) if n else F.col("row")
    placed = numbered.withColumn("position", position)
    return placed.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": whole(F.col("position"), shards)})


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def _sql(seed: int = SEED, walks: int = 8) -> str:
    """The same for DuckDB, with CRC-32 byte by byte; so many walks suffice on a table of a thousand rows."""
    mixed = "((xor(x, x >> 16) % {p}) * {c}) % {p}".replace("{p}", str(PRIME))
    levels, at = [], "start"
    for w in range(walks):
        first = f"SELECT k.*, CASE WHEN k.v < n.n THEN -1 ELSE k.v // n.m END AS l, CASE WHEN k.v < n.n THEN -1 ELSE k.v % n.m END AS r FROM {at} k, n" if w else f"SELECT k.*, k.v // n.m AS l, k.v % n.m AS r FROM {at} k, n"
        levels.append(f"w{w} AS ({first})")
        last = f"w{w}"
        for i, (a, b, c) in enumerate(round_keys(seed)):
            name = f"w{w}r{i}"
            step = mixed.replace("{c}", str(c))
            levels.append(f"{name} AS (SELECT k.* EXCLUDE (l, r, x), CASE WHEN l < 0 THEN l ELSE r END AS l, CASE WHEN l < 0 THEN r ELSE (l + ({step}) % n.m) % n.m END AS r FROM (SELECT *, ((r + {a}) % {PRIME} * {b}) % {PRIME} AS x FROM {last}) k, n)")
            last = name
        levels.append(f"done{w} AS (SELECT k.* EXCLUDE (l, r, v), CASE WHEN l < 0 THEN v ELSE l * n.m + r END AS v FROM {last} k, n)")
        at = f"done{w}"
    return f"""
    WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS x(i)),
    docs AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
    sums AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM docs, crc),
    n AS (SELECT count(*) AS n, CASE WHEN floor(sqrt(count(*))) * floor(sqrt(count(*))) >= count(*) THEN floor(sqrt(count(*)))::BIGINT ELSE floor(sqrt(count(*)))::BIGINT + 1 END AS m FROM documents),
    start AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS v FROM sums),
    {', '.join(levels)}
    SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {SHARDS})::INT AS shard, v // {SHARDS} AS slot, NULL::INT AS grown_shard FROM {at}
    """


OP6_SQL = _sql()
