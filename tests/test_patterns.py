"""The automaton against plain searches."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions import patterns
from brindle.functions.vectors import resolve_spans
from brindle.operators import alerts


def places(texts, terms):
    return sorted((i, m.start(), m.start() + len(t), t) for i, x in enumerate(texts) for t in set(terms) if t for m in re.finditer(b"(?=" + re.escape(t) + b")", x))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", max_size=30).map(str.encode), max_size=8), st.lists(st.text("abé", max_size=5).map(str.encode), max_size=8), st.sampled_from([1, 3, 4096]))
def test_finds_every_place(texts, terms, lanes):
    patterns.LANES, kept = lanes, patterns.LANES
    try:
        a = patterns.Automaton(terms)
        text, start, end, term = a.find(texts)
    finally:
        patterns.LANES = kept
    found = list(zip(text.tolist(), start.tolist(), end.tolist(), (a.terms[t] for t in term), strict=True))
    assert sorted(found) == places(texts, terms) and (np.diff(text) >= 0).all()


def plain_spans(text, surfaces):
    found = sorted(((m.start(), -len(s), s) for s in dict.fromkeys(surfaces) if s for m in re.finditer(f"(?={re.escape(s)})", text)))
    out, free = [], 0
    for start, minus, s in found:
        if start >= free:
            out.append((start, start - minus, s))
            free = start - minus
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abé中", max_size=30), st.lists(st.text("abé中", max_size=4), max_size=5)), max_size=6))
def test_leftmost_longest(rows):
    got = patterns.leftmost_longest([t.encode() for t, _ in rows], [[s.encode() for s in own] for _, own in rows])
    assert [[(a, b, s.decode()) for a, b, s in g] for g in got] == [plain_spans(*r) for r in rows]


def test_work_does_not_grow_with_the_terms():
    """The table has a row a state; the pass looks each byte up once, so the hits alone tell terms apart."""
    r = random.Random(1)
    terms = ["".join(r.choices("abcdefgh", k=r.randint(4, 9))).encode() for _ in range(5000)]
    texts = ["".join(r.choices("abcdefgh ", k=3000)).encode() for _ in range(20)]
    a = patterns.Automaton(terms)
    found = a.find(texts)
    some = random.Random(2).sample(terms, 30)
    assert sorted((i, s, e, a.terms[t]) for i, s, e, t in zip(*(x.tolist() for x in found), strict=True) if a.terms[t] in set(some)) == places(texts, some)


def test_spans_of_odd_rows(spark):
    rows = [(1, "Ana and Anabel, Ana", ["Ana", "Anabel", "", None]), (2, None, ["x"]), (3, "none", None), (4, "é中é", ["中"]), (5, "aaaa", ["aa"])]
    df = spark.createDataFrame(rows, "id long, text string, names array<string>")
    got = {r.id: [tuple(s) for s in r.s] for r in df.select("id", resolve_spans("text", "names").alias("s")).collect()}
    assert got == {1: [(0, 3, "Ana"), (8, 14, "Anabel"), (16, 19, "Ana")], 2: [], 3: [], 4: [(1, 2, "中")], 5: [(0, 2, "aa"), (2, 4, "aa")]}


@pytest.mark.parametrize("a_pass", [50_000, 3])
def test_rules_against_every_article(spark, monkeypatch, a_pass):
    monkeypatch.setattr(alerts, "TERMS_A_PASS", a_pass)
    r = random.Random(4)
    words = ["war", "peace", "Oil", "gas", "é", "w_r", "100%", "rate", "rates"]
    articles = [(i, r.choice([None, " ".join(r.choices(words, k=3))]), r.choice([None, "", " ".join(r.choices(words, k=6)).upper()]), r.choice([None, "en", "de"]), r.choice([None, -0.5, 0.2])) for i in range(40)]
    rules = [(i, "r", r.choice([None, "", ", ".join(r.choices(words, k=r.randint(1, 3)))]), r.choice([None, [], ["en"], ["de", "fr"]]), r.choice([None, None, 0.0]), r.choice([None, None, None, "n1"]), r.choice(["title", "content", "both"]), r.random() < 0.9) for i in range(60)]
    mentions = [(i, r.choice(["n1", "n2"])) for i in range(40)]

    def like(text, t):
        return re.search("".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in t), (text or "").lower(), re.S) is not None

    want = set()
    for rule, _, query, languages, most, node, place, enabled in rules:
        terms = [t for t in re.split(r"[,\s]+", (query or "").lower()) if t]
        for a, title, content, language, score in articles:
            said = not terms or any(place != "content" and like(title, t) or place != "title" and like(content, t) for t in terms)
            if enabled and said and (not languages or language in languages) and (most is None or score is not None and score <= most) and (node is None or (a, node) in mentions):
                want.add((rule, a))
    df = spark.createDataFrame(articles, "id long, title string, content string, language string, sentiment_score double").repartition(3)
    found = alerts.match(df, spark.createDataFrame(rules, alerts.RULES), spark.createDataFrame(mentions, "article_id long, node string")).select("rule_id", "article_id").collect()
    assert len(found) == len(set(found)) and {tuple(x) for x in found} == want
    assert alerts.match(df.limit(0), spark.createDataFrame(rules, alerts.RULES), spark.createDataFrame(mentions, "article_id long, node string")).count() == 0
