"""A rule bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule. A policy is a versioned mask of bits: applying it, changing
it, or asking what each of its rules does (ablation) is bit arithmetic over
the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import WHITE, map_arrow, table, text_bytes
from brindle.session import table_path

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_bangs long, n_upper long, n_lower long"


def repeated_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words that lie in a window of so many words which occurs twice or more, its first place included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    first: dict[tuple, int] = {}
    marked: set[int] = set()
    if len(set(windows)) == len(windows):
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            marked.add(i)
            marked.add(j)
    count, end = 0, 0
    for i in sorted(marked):
        count += i + width - max(i, end)
        end = i + width
    return count


def measured(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    continued = 0 if text.isascii() else len(text) - len(text.decode("utf-8", "replace"))  # bytes beyond a character's first
    in_words = len(text.translate(None, WHITE))
    gone = lambda drop: len(text) - len(text.translate(None, drop))
    return (len(words), in_words - continued, gone(SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(words), text.count(b"!"), gone(UPPER), gone(LOWER))


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the MEASURES of each whole text; a null text counts as empty, other columns are left out."""
    schema = f"doc_id long, {MEASURES}"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measured(x) for x in text_bytes(batch.column(1))]
        columns = zip(*rows, strict=True) if rows else [[]] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names)

    return map_arrow(docs.select("doc_id", text), work, schema)


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements is true; they are never null."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are never given to another rule once a ledger is written.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "bangs", "4 * n_bangs > n_words"),
    Rule(5, "capitals", "n_upper > n_lower and n_upper > 100"),
    Rule(6, "short_words", "word_chars < 2 * n_words"),
    Rule(7, "long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("web", 1, tuple(r.name for r in RULES))
#: A later version of the policy, which lets loud texts pass.
LENIENT = Policy("web", 2, tuple(r.name for r in RULES if r.name not in ("bangs", "capitals")))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bits of the rules that fail.

    A null or empty text fails few_words only. Repeated rows get a row each; a null doc_id stays null. An
    empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed: Column = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measurements(docs, text).withColumn("failed", failed)


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(book: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, that fail it alone, and that pass without it.

    One aggregation: the ledger shrinks to one row per pattern of bits (at most
    2 ** rules) before policies meet it.
    """
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    bits = {r.name: r.bit for r in rules}
    cases = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(mask(p, rules)).cast("long").alias("mask"), F.lit(1 << bits[name]).cast("long").alias("bit")) for p in policies for name in p.rules])
    met = patterns.select("failed", "n", F.explode(cases).alias("c")).select("failed", "n", "c.*").withColumn("hit", F.expr("failed & mask"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return met.groupBy("policy", "version", "rule").agg(
        n(F.expr("(failed & bit) <> 0")).alias("failing"),
        n(F.expr("hit = bit")).alias("failing_alone"),
        n(F.expr("hit = 0")).alias("kept"),
        n(F.expr("(hit & ~bit) = 0")).alias("kept_without"),
    )


def written_ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger, read back from a table in the shared folder: policies and ablations never touch a text again."""
    path = table_path(docs.sparkSession, "ledger")
    ledger(docs, rules).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of three policies does, from a written ledger; an empty table gives no rows."""
    return ablations(written_ledger(table(spark, sf_dir, "documents")), (BASE, DEFAULT, LENIENT))


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the base and the default policy; nulls, repeated rows and empty tables as in ledger()."""
    book = ledger(table(spark, sf_dir, "documents"))
    base = ~passes(BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(DEFAULT)).alias("kept"), "failed")


_W = r"[^\x20\x09-\x0D]+"
_BITS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
m AS (SELECT doc_id, text, w, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM t),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) >= 3),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (SELECT DISTINCT doc_id, i + o AS at FROM found, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
facts AS (SELECT m.*, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM m LEFT JOIN rep r ON m.doc_id = r.doc_id),
bits AS (SELECT *, ({' + '.join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS failed FROM facts)
"""
OP1_SQL = _BITS + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {mask(BASE)}) <> 0 AS base_failed, (failed & {mask(DEFAULT)}) = 0 AS kept, failed FROM bits
"""


def _ablations_sql(policies: Sequence[Policy]) -> str:
    bits = {r.name: 1 << r.bit for r in RULES}
    cases = ", ".join(f"('{p.name}', {p.version}, '{name}', {mask(p)}, {bits[name]})" for p in policies for name in p.rules)
    return _BITS + f""", cases(policy, version, rule, mask, bit) AS (VALUES {cases})
SELECT policy, version, rule, count(*) FILTER ((failed & bit) <> 0) AS failing, count(*) FILTER ((failed & mask) = bit) AS failing_alone,
       count(*) FILTER ((failed & mask) = 0) AS kept, count(*) FILTER ((failed & mask & ~bit) = 0) AS kept_without
FROM bits, cases GROUP BY policy, version, rule
"""


ABLATIONS_SQL = _ablations_sql((BASE, DEFAULT, LENIENT))
