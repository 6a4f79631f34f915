"""Text functions on literal cases."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text as t
from brindle.functions import vectors as v


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'string' if isinstance(x, (str, type(None))) else 'array<double>'}" for k, x in values.items()))
    return row.select(column.alias("x")).first().x


NORMALIZED = {
    "Скопје": "skopje", "Македонија": "makedonija", "İstanbul": "istanbul", "TİRAN": "tiran", "Türkiye": "turkiye", "Tiranë": "tirane", "  Skopje  ": "skopje", "": "",
    "north-macedonia": "northmacedonia", "skopje12": "skopje", "a b\tc d": "a b c d", "Straße": "strae", "Ѓорче Њ": "gjorche nj", "ét́": "et", "ＡＢ": "ab", None: "",
}


def test_normalized(spark):
    rows = spark.createDataFrame(list(NORMALIZED.items()), "a string, b string").select("a", "b", t.normalized(F.col("a")).alias("x")).collect()
    assert [(r.a, r.x) for r in rows] == [(r.a, r.b) for r in rows]


def plain(s):
    """The rule said in plain Python."""
    from brindle.functions.values import FOLDED, MACEDONIAN

    s = "".join(MACEDONIAN.get(c.lower(), c) if c.lower() in MACEDONIAN else FOLDED.get(c, c) for c in s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = "".join(c for c in " ".join(s.lower().split()) if "a" <= c <= "z" or c == " ")
    return " ".join(s.split())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=40), min_size=20, max_size=20))
def test_normalized_is_the_rule(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "a string").select("a", t.normalized(F.col("a")).alias("x"), t.normalized(t.normalized(F.col("a"))).alias("again")).collect()
    for r in rows:
        assert r.x == plain(r.a) and r.again == r.x


LANGUAGES = {"Скопје е главен град": "mk", "Bu bir örneğidir": "tr", "Kjo është një fjali": "sq", "This is English": "en", "": "en", "<b>ğ</b>": "tr", "It is English": "en"}


def test_language(spark):
    rows = spark.createDataFrame(list(LANGUAGES.items()), "a string, b string").select("a", "b", t.language_by_cues(F.col("a")).alias("x"), t.language_by_cues(F.col("a"), True).alias("s")).collect()
    assert all(r.x == r.b for r in rows)
    assert {r.a: r.s for r in rows}["It is English"] == "tr"


@pytest.mark.parametrize("text,language,label,hits", [("Криза и корупција предизвикаа насилство.", "mk", "neg", 3), ("sukses rritje paqe", "sq", "pos", 3), ("başarı barış zafer", "tr", "pos", 3), ("nothing", "mk", "neutral", 0), ("kriza", "en", "neutral", 0)])
def test_lexicon(spark, text, language, label, hits):
    x = one(spark, t.lexicon_sentiment(t.normalized(F.col("a")), F.lit(language)), a=text)
    assert (x.label, x.hits) == (label, hits)


PREDICATES = {"was appointed as minister": "appointed", "is located in Berlin": "located_in", "had a meeting with her": "met_with", "тој изјави": "stated", "açıkladı": "stated", "deklaroi": "stated", "sunny weather": None, "": None}


def test_predicate(spark):
    rows = spark.createDataFrame(list(PREDICATES.items()), "a string, b string").select("a", "b", t.predicate(F.col("a")).alias("x")).collect()
    assert [(r.a, r.x) for r in rows] == [(r.a, r.b) for r in rows]


def test_summary(spark):
    s = ["A short one.", "This sentence is of a fair length, long enough to be kept.", "Another one that is also of a fair length and says more.", "And a third of fair length that would go beyond all limits of it."]
    assert one(spark, t.summary(F.col("a")), a="One. Two.") == "One. Two."
    assert one(spark, t.summary(F.col("a")), a=None) == ""
    got = one(spark, t.summary(F.col("a"), 120), a=" ".join(s))
    assert got == f"{s[0]} {s[1]}"  # scores 0.6 and 0.75 are the best, and the next no longer fits


def test_small_functions(spark):
    assert one(spark, t.sentences(F.col("a")), a="One. Two! Three?\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, t.base_form(F.col("a")), a="tirane") == "tiran"
    assert one(spark, t.base_form(F.col("a")), a="ana") == "ana"
    assert one(spark, t.word_count(F.col("a")), a="  a b c\n") == 3
    assert one(spark, t.escaped(F.col("a")), a="a<b>&c") == "a&lt;b&gt;&amp;c"
    assert one(spark, t.memory_mb(F.col("a")), a="1.5GiB / 7GiB") == 1536.0
    assert one(spark, t.url_hash(F.col("a")), a=" http://A.b/c// ") == one(spark, t.url_hash(F.col("a")), a="http://a.B/c")
    assert one(spark, t.content_hash(F.col("a")), a="\n x \t") == one(spark, t.content_hash(F.col("a")), a="x")
    s = one(spark, t.softmax_sentiment(F.col("a")), a=[3.0, 0.0, 0.0])
    assert s.label == "neg" and -1 < s.score < -0.8
    assert one(spark, t.sentiment(F.col("a"), F.lit("mk")), a=" ").method == "none"
    assert one(spark, t.first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"


def test_vectors(spark):
    assert one(spark, v.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, v.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, v.cosine(F.col("a"), F.col("b")), a=[], b=[1.0]) == 0
    assert sum(x * x for x in one(spark, v.hash_embedding("a"), a="one two two")) == pytest.approx(1)
    for a, b, want in (("shkup", "shkupi", 1.0), ("abcd", "wxyz", 0.0), ("same", "same", 1.0), ("tirane", "tiran", 1.0), ("a", "ai", 2 / 3)):
        assert one(spark, v.entity_similarity("a", "b"), a=a, b=b) == pytest.approx(want)
    assert one(spark, v.entity_similarity("a", "b"), a="macedonia", b="maqedonia") > 0.8
    assert [tuple(x) for x in one(spark, v.resolve_spans(F.col("a"), F.split(F.lit("ab,abc,c"), ",")), a="abcabc")] == [(0, 3, "abc"), (3, 6, "abc")]


def test_span_iou(spark):
    rows = spark.createDataFrame([(0, 10, 5, 15, 1 / 3), (0, 5, 5, 9, 0.0), (1, 3, 1, 3, 1.0)], "a int, b int, c int, d int, x double")
    assert all(r.x == pytest.approx(r.y) for r in rows.select("x", v.span_iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("y")).collect())


def hashed(text):
    """Worked out from the rule, one token at a time."""
    found = re.findall(r"\w+", text.lower()) or [text[i : i + 3] for i in range(len(text) - 2)]
    out = [0.0] * 384
    for token in found:
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        out[h % 384] += 1 if h >> 9 & 1 else -1
    norm = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / norm for x in out]


def test_hash_embedding(spark):
    texts = ["one two two", "Größe groß", "!?", "!?-", "--..--", "", "x" * 500, "a b c d e f g h i j"]
    rows = spark.createDataFrame([(x,) for x in texts], "a string").select("a", v.hash_embedding("a").alias("x")).collect()
    assert all(r.x == pytest.approx(hashed(r.a)) for r in rows)
    assert one(spark, v.hash_embedding("a"), a=None) == [0.0] * 384
    # md5("one") ends in ...c6: the number's remainder by 384 and its bit 9, by hand
    h = int("f97c5d29941bfb1b2fdab0874906ab82", 16)
    assert one(spark, v.hash_embedding("a"), a="one")[h % 384] == (1.0 if h >> 9 & 1 else -1.0)


def test_placed_sentences(spark):
    text = "One. Two!  Three?\n\n Four. One. "
    got = one(spark, t.placed_sentences(F.col("a")), a=text)
    assert [x.text for x in got] == one(spark, t.sentences(F.col("a")), a=text)
    assert all(text[x.start : x.start + len(x.text)] == x.text for x in got) and [x.start for x in got] == sorted(x.start for x in got)
