"""Mixing sources to target weights by Poisson replication.

A source of n documents with target share w of a total T gets the mean repetition
rate T * w / n. Each document draws its count from a Poisson distribution with that
mean by inverting its cumulative sums at a number hashed from seed and key, is
exploded by the count, and the replicas are shuffled over all partitions by a
second hash. A large rate is drawn in parts, and documents of such rates are dealt by
part before they are exploded, so that no task makes all replicas of a document. A draw
depends on nothing but seed, key and rate, so that any task can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import join_measured, table
from brindle.session import cut_lineage

SEED = 7
#: Exponent of the source sizes that gives the target weights: 0 gives all sources the same share, 1 leaves the mix as it is.
TEMPERATURE = 0.5
#: Total target size, as a multiple of the number of documents.
TOTAL = 1.0
#: The largest rate that is inverted in one piece; a larger one is the sum of equal parts.
PART = 16.0
#: Parts of a document that are summed up at a time.
BLOCK = 256


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and keys; a null key counts as the word null."""
    name = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def cumulative(rate: Column) -> Column:
    """The Poisson probabilities of up to 0, 1, 2, ... as an array, as far as doubles tell them from 1.

    Terms are summed from their logarithms, so that no rate underflows. The array is rebuilt at each step, which
    is why no rate above PART is inverted in one piece.
    """
    last = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("sums"))

    def add(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + F.exp(log_p))).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["sums"])
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def drawn_counts(cdf: Column, parts: Column, seed: int, key: Column) -> Column:
    """One count for each of the ``parts`` of a rate: how many of the cumulative probabilities a hashed number reaches.

    The sum of independent Poisson counts is a Poisson count of the summed rate. Part 0 is
    hashed from seed and key alone, so that a rate of one part draws as if there were none.
    """
    u = lambda j: F.when(j == 0, uniform(f"count:{seed}", key)).otherwise(uniform(f"count:{seed}", key, j))
    below = lambda x: F.size(F.filter(cdf, lambda c: c <= x)).cast("long")
    one = F.array(below(uniform(f"count:{seed}", key)))
    return F.when(parts == 1, one).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.element_at(F.transform(F.array(u(j)), below), 1)))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float = TOTAL, source: str = "source") -> DataFrame:
    """One row per source: source, documents, rate, cdf.

    ``weights`` are target shares by source (sources it lacks get none); without them a
    source of n documents has weight n ** temperature. Shares are scaled to sum
    to 1 over the sources that occur. A null source is a source like any other.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("documents"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("documents").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weighed = sizes.withColumn("w", F.coalesce(named[F.coalesce("source", F.lit(""))], F.lit(0.0)))
    weighed = cut_lineage(weighed)
    all_w, all_n = weighed.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("documents"), F.lit(0))).first()  # two numbers
    rate = F.col("w") / F.lit(all_w) * F.lit(all_n) * float(total) / F.col("documents") if all_w > 0 else F.lit(0.0)
    return weighed.select("source", "documents", rate.alias("rate"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _sums_before(counts: Column, first: Column) -> Column:
    """For each count the sum of those before it, from ``first`` on."""
    start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(counts, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _own(name: str, taken: list[str]) -> str:
    """A name for a column of ours that the input doesn't use."""
    while name in taken:
        name = f"_{name}"
    return name


def poisson_replicas(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float = TOTAL, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every document as often as it is drawn, with ``replica`` (from 0), ``replicas`` and ``rate``.

    Repeated rows share their draw. A null key draws like a key of its own, a null source is a source. An empty table
    gives no rows. Columns of the input keep their names; those named like the three
    new ones are replaced. Sources are joined by a broadcast while they are counted to be few;
    beyond that by a shuffled join whose hot sources AQE splits.
    """
    rates = cut_lineage(repetition_rates(docs, weights, temperature, total, source))
    kept = [c for c in docs.columns if c not in ("replica", "replicas", "rate")]
    name, met, cdf, parts, counts, place = (_own(x, kept) for x in ("source_name", "source_rate", "source_cdf", "source_parts", "part_counts", "part_place"))
    n = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("long")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    rates = rates.select(named(F.col("source")).alias(name), F.col("rate").alias(met), n.alias(parts), cumulative(F.col("rate") / n).alias(cdf))
    drawn = join_measured(docs.select(*kept).withColumn(name, named(F.col(source))), rates, name, "inner")
    counted = drawn.withColumn(counts, drawn_counts(F.col(cdf), F.col(parts), seed, F.col(key))).drop(name, cdf)
    counted = counted.withColumn("replicas", _total(F.col(counts))).where("replicas > 0")

    def exploded(rows: DataFrame, first: Column, size: Column) -> DataFrame:
        return rows.withColumn("replica", F.explode(F.sequence(first, first + size - 1))).select(*kept, F.col(met).alias("rate"), "replicas", "replica")

    zero = F.lit(0).cast("long")
    if (rates.agg(F.max(parts)).first()[0] or 1) == 1:
        return exploded(counted, zero, F.col("replicas"))
    few, many = counted.where(F.col(parts) == 1), counted.where(F.col(parts) > 1)
    # a part's first replica comes from sums over blocks of parts, and over the parts of its block
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / BLOCK).cast("int")), lambda b: F.slice(counts, b * BLOCK + 1, BLOCK))
    sums = _sums_before(F.transform(blocks, _total), zero)
    cut = many.withColumn(place, F.explode(F.arrays_zip(sums.alias("first"), blocks.alias("sizes")))).drop(counts)
    inner = F.arrays_zip(_sums_before(F.col(f"{place}.sizes"), F.col(f"{place}.first")).alias("first"), F.col(f"{place}.sizes").alias("size"))
    each = cut.withColumn(place, F.explode(inner)).where(F.col(f"{place}.size") > 0)
    dealt = _own("part_dealt", each.columns)  # as a column: a partitioning by an expression over all columns takes the planner very long
    each = each.withColumn(dealt, F.xxhash64(F.lit(f"part:{seed}"), F.col(key), F.col(f"{place}.first"), _row_hash(each, kept))).repartition(dealt).drop(dealt)
    return exploded(few, zero, F.col("replicas")).unionByName(exploded(each, F.col(f"{place}.first"), F.col(f"{place}.size")))


def _row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash of a row's own values, maps aside, which can't be hashed."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(F.lit(0), *[F.col(c) for c in columns if "map<" not in kinds[c]])


def shuffled(replicas: DataFrame, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """The replicas dealt over all partitions and ordered within them by a hash of seed, key and replica, and of the row; each is computed once.

    A place depends on the row alone, so a task that is run again after a lost executor sends its rows where they went before, in whatever order they reach it.
    Rows that are equal in all columns share a place.
    """
    place, tie = _own("place", replicas.columns), _own("tie", replicas.columns)
    at = F.xxhash64(F.lit(f"place:{seed}"), F.coalesce(F.col(key), F.lit(-1).cast("long")), F.col("replica"))
    placed = replicas.withColumns({place: at, tie: _row_hash(replicas, replicas.columns)})
    return placed.repartition(F.col(place), F.col(tie)).sortWithinPartitions(place, tie).drop(place, tie)


def op3_poisson_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, as often as poisson_replicas() draws them, in shuffled order; odd rows and empty tables as stated there."""
    docs = table(spark, sf_dir, "documents")
    return shuffled(poisson_replicas(docs)).withColumn("rate", F.round("rate", 9))


OP3_SQL = f"""
WITH docs AS (SELECT *, row_number() OVER () AS r FROM documents),
sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () * {TOTAL} / n AS rate FROM sizes),
cut AS (SELECT *, greatest(1, ceil(rate / {PART}))::BIGINT AS parts FROM rates),
terms AS (SELECT source, k, exp(-rate / parts + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / parts) - ln(greatest(k, 1)::DOUBLE) END) OVER (PARTITION BY source ORDER BY k)) AS p
          FROM cut, unnest(range(0, ceil(rate / parts + sqrt(rate / parts) * 12 + 40)::BIGINT + 1)) AS t(k)),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
drawn AS (SELECT d.r, c.rate, (('0x' || substr(md5('count:{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || CASE WHEN j > 0 THEN ':' || j ELSE '' END), 1, 13))::BIGINT)::DOUBLE / {2**52} AS u, f.cs
          FROM docs d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source JOIN cdf f ON d.source IS NOT DISTINCT FROM f.source, unnest(range(0, c.parts)) AS t(j)),
counted AS (SELECT r, any_value(rate) AS rate, sum(len(list_filter(cs, lambda c: c <= u)))::BIGINT AS replicas FROM drawn GROUP BY r)
SELECT d.* EXCLUDE (r), replica, replicas, round(rate, 9) AS rate FROM docs d JOIN counted USING (r), unnest(range(0, replicas)) AS t(replica)
"""
