"""Secret scans: three fixed forms, and sliding-window entropy over candidate strings.

A candidate is a maximal run of at least WINDOW characters of one class. Its Shannon
entropy is followed by a window that slides one character at a time: counts per
character, and the sum of c * log2(c), are changed only for the character that enters
and the one that leaves. A candidate whose largest window entropy reaches its class's
threshold is a secret. The allow-list takes known stretches out of a candidate (alphabets, digits in order,
examples), and what is left between them is judged by itself. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._common import table

#: The fixed forms, in the order in which they are listed: kind, pattern, group whose length counts, least length.
FORMS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
WINDOW = 20
#: Character classes of candidates: kind, class, least entropy in bits of a window. No window of 20 has exactly these entropies.
CLASSES = (("entropy_hex", "[0-9A-Fa-f]", 3.01), ("entropy_base64", "[A-Za-z0-9+/=_-]", 3.87))
WIDEST = CLASSES[-1][1]
#: Stretches that are no secrets: ten or more digits or letters in order (an alphabet, all digits), and examples. What is left of a candidate between them is still looked at.
ALLOWED = r"abcdefghij(?:klmnopqrstuvwxyz)?|ABCDEFGHIJ(?:KLMNOPQRSTUVWXYZ)?|0123456789(?:abcdef|ABCDEF)?|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]"
#: What is left is no secret if it is a mere number, or letters and marks that read like words: without capitals that change
#: within two letters, and without seven consonants in a row.
NUMBER, DIGIT = r"^[0-9+/=_-]*$", r"[0-9]"
UNREADABLE = r"[A-Z][a-z][A-Z]|[a-z][A-Z][A-Z][a-z]|[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{7}"
KINDS = tuple(f[0] for f in FORMS) + tuple(c[0] for c in CLASSES)
MASK = "[SECRET]"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, whole match), in code points.

    Positions come from the lengths of what stands between the matches.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"))  # one gap more than hits
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,hit:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        stop = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        more = F.array(F.struct(at.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))
        return F.struct(stop.alias("at"), F.when(x["hit"].isNull(), s["found"]).otherwise(F.concat(s["found"], more)).alias("found"))

    return F.aggregate(both, start, step, lambda s: s["found"])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def max_window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest entropy in bits of a window over the candidate; candidates are ASCII and at least a window long.

    The state is the count of each letter in the window, the sum of c * log2(c)
    over the counts, and the smallest such sum of a full window so far.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    term = lambda c: F.element_at(terms, c + 1)

    def moved(s: Column, code: Column, by: int) -> Column:
        """The state after a letter has entered or left."""
        c = F.element_at(s["counts"], code)
        counts = F.transform(s["counts"], lambda n, k: n + F.when(k + 1 == code, by).otherwise(0))
        return F.struct(counts.alias("counts"), (s["sum"] + term(c + by) - term(c)).alias("sum"), s["least"].alias("least"))

    def ended(s: Column, full: Column) -> Column:
        return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), F.when(full, F.least(s["least"], s["sum"])).otherwise(s["least"]).alias("least"))

    def slid(codes: Column, n: Column) -> Column:
        start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda x: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

        def step(s: Column, i: Column) -> Column:
            grown = lambda t: bound(moved(t, F.element_at(codes, i), 1), lambda u: ended(u, i >= window))
            return bound(F.when(i > window, moved(s, F.element_at(codes, i - window), -1)).otherwise(s), grown)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)

    def numbered(letters: Column) -> Column:
        return bound(F.array_distinct(letters), lambda alphabet: bound(F.transform(letters, lambda x: F.array_position(alphabet, x).cast("int")), lambda codes: slid(codes, F.size(alphabet))))

    return bound(F.split(candidate, ""), numbered)


def _long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(F.regexp_extract(x["hit"], pattern, group)) >= least


def _risky(least: float) -> Callable[[Column], Column]:
    """Whether any stretch of a candidate, between what the allow-list knows, has a window of that entropy and doesn't read like words or a number."""

    def secret(rest: Column) -> Column:
        plain = rest.rlike(NUMBER) | ~(rest.rlike(DIGIT) | rest.rlike(UNREADABLE))
        return F.when((F.length(rest) >= WINDOW) & ~plain, max_window_entropy(rest) >= least).otherwise(False)

    return lambda x: F.exists(F.split(x["hit"], ALLOWED, -1), secret)


def _kind_spans(text: Column, gate: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None) -> Column:
    """array of (start, kind index, stop); only texts that pass the gate and have a match are cut up."""
    found = matches(text, pattern)
    found = F.filter(found, keep) if keep else found
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))
    return F.when(gate & text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int>>"))


def _spans(text: Column) -> Column:
    """array of (start, kind index, stop), all kinds together."""
    # what can't hold a match is told by one cheap pass: all forms but the first are
    # runs of at least WINDOW characters of the widest class, and the first has a : or =
    run = text.rlike(f"(?<!{WIDEST}){WIDEST}{{{WINDOW}}}")
    assigns = text.contains(":") | text.contains("=")
    parts = []
    for kind, (name, pattern, group, least) in enumerate(FORMS):
        # runs of one class, and AKIA with what follows, can be asked for at their least length at once
        lean = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(name, pattern)
        parts.append(_kind_spans(text, assigns if group else run, lean, kind, _long_enough(pattern, group, least) if group else None))
    for kind, (_, chars, least) in enumerate(CLASSES, len(FORMS)):
        parts.append(_kind_spans(text, run, f"{chars}{{{WINDOW},}}", kind, _risky(least)))
    return F.concat(*parts)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``spans``: array of (start, stop, kind), in code points, stop exclusive, by start and then kind as listed in KINDS.

    A null or empty text has no spans. Rows are looked at one by one, so repeated rows
    have equal spans. A column of the input that is named spans is replaced.
    """
    return docs.withColumn("spans", _found(F.col(text)))


def _found(text: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    ordered = F.array_sort(_spans(F.coalesce(text, F.lit(""))))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.element_at(names, x["kind"] + 1).alias("kind")))


def redacted(text: Column, spans: Column, by: str = MASK) -> Column:
    """The text with every run of overlapping spans replaced by a mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        kept = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(by))).otherwise(s["out"])
        return F.struct(kept.alias("out"), F.greatest(s["at"], x["stop"]).alias("at"))

    full = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, full).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in text are masked, and n_chars follows. Texts without secrets stay as they are."""
    name = "spans"
    while name in docs.columns:  # a column of the input keeps its name
        name = f"_{name}"
    masked = docs.withColumn(name, _found(F.col("text")))
    masked = masked.withColumn("text", redacted(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents, counted and joined; odd rows and empty tables as stated there."""
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    base = [f[0] for f in FORMS]
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(written(F.filter("spans", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    found = []
    for k, (kind, pattern, group, least) in enumerate(FORMS):
        p = quoted(pattern)
        found.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, gaps, hits, len(hits) AS n,
            list_transform(hits, lambda h: length(regexp_extract(h, '{p}', {group})) >= {least}) AS good
            FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM docs WHERE regexp_matches(text, '{p}'))""")
    for k, (kind, chars, least) in enumerate(CLASSES, len(FORMS)):
        p = f"{chars}{{{WINDOW},}}"
        found.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, gaps, hits, len(hits) AS n,
            list_transform(hits, lambda h: len(list_filter(string_split_regex(h, '{ALLOWED}'), lambda x: length(x) >= {WINDOW} AND NOT regexp_matches(x, '{NUMBER}')
              AND (regexp_matches(x, '{DIGIT}') OR regexp_matches(x, '{UNREADABLE}'))
              AND list_max(list_transform(range(1, length(x) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(x, i, {WINDOW}), ''), 'entropy'))) >= {least})) > 0) AS good
            FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM docs WHERE regexp_matches(text, '{p}'))""")
    counts = ", ".join(f"count(*) FILTER (kind = '{f[0]}') AS n_{f[0]}" for f in FORMS)
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({' UNION ALL '.join(found)}),
    each AS (SELECT doc_id, k, kind, good[i] AS good, length(hits[i]) AS len,
        list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start
        FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM found)),
    spans AS (SELECT doc_id, k, kind, start, kind || ':' || start::BIGINT || ':' || (start + len)::BIGINT AS span FROM each WHERE good),
    joined AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(FORMS)}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{f[0]}, 0) AS n_{f[0]}' for f in FORMS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN joined j ON d.doc_id = j.doc_id
    """


OP5_SQL = _sql()
