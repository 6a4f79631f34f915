"""Text functions on columns, all within the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.values import FOLDED, MACEDONIAN, PREDICATES, SENTIMENT, SUFFIXES


@cache
def fold_table() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer): single characters to one ASCII letter or space, and those that give several letters.

    Built by rule over all planes: Macedonian letters and FOLDED as listed, all
    others by compatibility decomposition without combining marks.
    """
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    listed = {**MACEDONIAN, **{k.upper(): v for k, v in MACEDONIAN.items()}, **FOLDED}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if c in listed:
            plain = listed[c]
        elif c.isspace():
            plain = " "
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            plain = "".join(x for x in plain if "a" <= x <= "z" or x.isspace())
        if len(plain) == 1:
            one[c] = plain
        elif len(plain) > 1:
            several[c] = plain
    return "".join(one), "".join(one.values()), several


def normalized(text: Column) -> Column:
    """Latin letters a-z and single spaces: transliterated, folded, in lower case; all else is deleted. A null gives an empty string.

    Characters that fold to several letters (Macedonian digraphs, ligatures, squared words) are
    replaced first: texts without any are told by one pass, and others take a step for each such character.
    """
    source, target, several = fold_table()
    plain = F.coalesce(text, F.lit(""))
    letters = "".join(sorted(several))
    longer = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    expanded = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(longer[c], c)), "")
    # texts of ASCII have none of them and nothing to fold; of others deleting them tells
    folds = plain.rlike(r"[^\x00-\x7F]")
    has = F.length(F.translate(plain, letters, "")) < F.length(plain)
    plain = F.when(folds, F.translate(F.when(has, expanded).otherwise(plain), source, target)).otherwise(plain)
    out = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[\t-\r\x1c-\x1f]", " "), "[^a-z ]", "")
    # a single space is what it becomes, so that few places of a text match
    return F.trim(F.regexp_replace(out, "  +", " "))


def tokens(text: Column) -> Column:
    """The words of a normalised text, in order."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def base_form(name: Column) -> Column:
    """Without one ending, the shortest that fits, if four letters or more remain."""
    out = F.trim(name)
    chain = None
    for suffix in sorted(SUFFIXES, key=len):
        fits = F.endswith(out, F.lit(suffix)) & (F.length(out) - len(suffix) >= 4)
        cut = F.substring(out, F.lit(1), F.length(out) - len(suffix))
        chain = F.when(fits, cut) if chain is None else chain.when(fits, cut)
    return chain.otherwise(out)


def language_by_cues(text: Column, strict_compat: bool = False, classifier=None) -> Column:
    """mk, tr, sq or en by script and letters; ``classifier`` (a column function) decides what has no cue.

    With ``strict_compat`` a bare capital I counts as Turkish, as it does in the original data.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    turkish = "[ğışĞIŞ]" if strict_compat else "[ğışĞİŞ]"
    rest = classifier(clean) if classifier else F.lit("en")
    supported = F.when(rest.isin("mk", "sq", "tr", "en"), rest).otherwise("en") if classifier else rest
    return F.when(clean == "", "en").when(clean.rlike("[\\u0400-\\u04FF]"), "mk").when(clean.rlike(turkish), "tr").when(clean.rlike("[ëË]"), "sq").otherwise(supported)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$", "")


def url_hash(url: Column) -> Column:
    return F.sha2(F.lower(F.regexp_replace(stripped(url), "/+$", "")).cast("binary"), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(stripped(content).cast("binary"), 256)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def escaped(text: Column) -> Column:
    """With &, < and > written as entities."""
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def sentences(text: Column, ends: str = ".!?") -> Column:
    """Trimmed sentences; ends at a mark with white space after it, or at a line end."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[{ends}])\s+|\n+")
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def placed_sentences(text: Column, ends: str = ".!?") -> Column:
    """Array of (start, text) of sentences(), with the place of each; one pass over the pieces and what parts them."""
    gap = rf"(?<=[{ends}])\s+|\n+"
    whole = F.coalesce(text, F.lit(""))
    both = F.arrays_zip(F.split(whole, gap, -1).alias("piece"), F.regexp_extract_all(whole, F.lit(f"({gap})"), F.lit(1)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate(both, start, lambda s, x: F.struct((s["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["gap"]), F.lit(0))).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    lead = lambda piece: F.length(piece) - F.length(F.ltrim(piece))
    made = F.zip_with(places, both, lambda at, x: F.struct((at + lead(x["piece"])).cast("long").alias("start"), F.trim(x["piece"]).alias("text")))
    return F.filter(made, lambda s: s["text"] != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def summary(text: Column, most: int = 220) -> Column:
    """The leading sentences of fair length that fit, in their order.

    A sentence's score falls with its place; one shorter than 40 or longer than 220
    characters loses 0.4. The best are taken until one no longer fits.
    """

    def picked(every: Column) -> Column:
        def placed(s: Column, i: Column) -> Column:
            loss = -(1.0 - i / F.size(every)) + F.when(F.length(s).between(40, 220), 0.0).otherwise(0.4)
            return F.struct(loss.alias("loss"), i.alias("i"), s.alias("s"))

        def take(acc: Column, x: Column) -> Column:
            fits = acc["open"] & ((acc["used"] == 0) | (acc["used"] + F.length(x["s"]) + 1 <= most))
            place = F.array_position(every, x["s"]).cast("int")  # an equal sentence's first place
            more = F.concat(acc["taken"], F.array(F.struct(place.alias("i"), x["s"].alias("s"))))
            return F.when(fits, F.struct((acc["used"] + F.length(x["s"]) + 1).alias("used"), F.lit(True).alias("open"), more.alias("taken"))).otherwise(
                F.struct(acc["used"].alias("used"), F.lit(False).alias("open"), acc["taken"].alias("taken"))
            )

        start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<struct<i:int,s:string>>").alias("taken"))
        in_order = lambda a: F.array_join(F.transform(F.array_sort(a["taken"]), lambda t: t["s"]), " ")
        chosen = F.aggregate(F.array_sort(F.transform(every, placed)), start, take, in_order)
        total = F.aggregate(every, F.lit(0), lambda a, s: a + F.length(s))
        return F.when(F.size(every) == 0, "").when(total <= most, F.array_join(every, " ")).otherwise(chosen)

    return bound(sentences(text, ends=".!?…"), picked)


def predicate(text: Column, is_normalized: bool = False) -> Column:
    """The predicate of the leftmost phrase in the text (the longest of those that begin there); null without one."""
    known = F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair])
    hit = F.regexp_extract(text if is_normalized else normalized(text), "(" + "|".join(sorted(PREDICATES, key=lambda p: -len(p))) + ")", 1)
    return F.when(hit != "", known[hit])


def tells(text: Column) -> Column:
    """Whether predicate() finds a phrase in a text. A text has one if any part of it has."""
    rest: dict[str, list[str]] = {}
    for p in sorted(PREDICATES):
        rest.setdefault(p[0], []).append(p[1:])
    return normalized(text).rlike("|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in rest.items()))


def lexicon_sentiment(norm: Column, language: Column) -> Column:
    """struct(score, label, hits) of a normalised text by its language's word list."""
    maps = {lang: F.create_map(*[F.lit(x) for pair in words.items() for x in pair]) for lang, words in SENTIMENT.items()}
    found = F.regexp_extract_all(F.coalesce(norm, F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))
    weights = None
    for lang, words in maps.items():
        hit = _weights(found, words)
        weights = F.when(language == lang, hit) if weights is None else weights.when(language == lang, hit)
    weights = weights.otherwise(F.array().cast("array<double>"))
    raw = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    score = raw / (F.abs(raw) + 2.0)
    label = F.when(F.size(weights) == 0, "neutral").when(score >= 0.05, "pos").when(score <= -0.05, "neg").otherwise("neutral")
    return F.struct(F.bround(score, 3).alias("score"), label.alias("label"), F.size(weights).alias("hits"))


def _weights(found: Column, words: Column) -> Column:
    return F.filter(F.transform(found, lambda t: words[t]), lambda w: w.isNotNull())


def sentiment(text: Column, language: Column, english=None, transformer=None) -> Column:
    """struct(score, label, hits, method): none for blank texts, else a transformer if one is plugged in, word lists for mk, sq and tr, and ``english`` (a column function giving a compound score) for the rest."""
    norm = normalized(text)
    listed = lexicon_sentiment(norm, language)
    compound = english(text) if english else F.lit(0.0)
    label = lambda s: F.when(s >= 0.05, "pos").when(s <= -0.05, "neg").otherwise("neutral")
    made = lambda s, lab, hits, m: F.struct(s.alias("score"), lab.alias("label"), hits.alias("hits"), F.lit(m).alias("method"))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    out = F.when(blank, made(F.lit(0.0), F.lit("neutral"), F.lit(0), "none"))
    if transformer:
        return out.otherwise(made(transformer(text), label(transformer(text)), F.lit(0), "transformer"))
    return out.when(language.isin(*SENTIMENT), made(listed["score"], listed["label"], listed["hits"], "lexicon")).otherwise(made(compound, label(compound), F.lit(0), "english"))


def softmax_sentiment(logits: Column) -> Column:
    """struct(score, label) of three logits (negative, neutral, positive): the winner's probability, signed."""
    top = F.array_max(logits)
    shares = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    at = F.array_position(logits, top)
    best = F.element_at(shares, at.cast("int")) / total
    return F.struct(F.when(at == 1, -best).when(at == 3, best).otherwise(F.lit(0.0)).alias("score"), F.element_at(F.array(F.lit("neg"), F.lit("neutral"), F.lit("pos")), at.cast("int")).alias("label"))


def memory_mb(text: Column) -> Column:
    """Megabytes of a figure like 1.5GiB; null if it isn't one."""
    value = F.nullif(F.regexp_extract(text, r"^\s*([0-9.]+)\s*[KMG]i?B", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(text, r"([KMG])i?B", 1)
    return value * F.when(unit == "G", 1024.0).when(unit == "K", 1 / 1024).otherwise(1.0)
