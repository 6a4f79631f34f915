"""Substring dedup against brute force: contexts, merges, groups that are cut, odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import suffixes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length):
    """The removed stretches of each text."""
    count = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x) + 2, np.int8)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        out.append(np.flatnonzero(np.diff(gone)).tolist())
    return out


def invented(seed, n=60, words=40):
    """Texts of few words with passages, copies, repeats and runs of one letter."""
    r = random.Random(seed)
    bag = ["".join(r.choice("abcdé\x00") for _ in range(r.randint(1, 9))) for _ in range(words)]
    passages = [" ".join(r.choices(bag, k=r.choice([5, 9, 12, 40]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice([r.choice(passages), " ".join(r.choices(bag, k=12)), "z" * r.randint(0, 90), "ab" * r.randint(0, 40)]) for _ in range(r.randint(0, 6))]
        texts.append(" | ".join(parts))
    return texts + texts[:3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00", min_size=32, max_size=120).map(str.encode), min_size=1, max_size=12), st.integers(1, 4))
def test_merge_is_brute_force(strings, shards):
    count = collections.Counter(s[i : i + 32] for s in strings for i in range(len(s) - 31))
    for s, runs in zip(strings, suffixes.repeated_strings(strings, 32, shards), strict=True):
        found = {i for a, b in zip(runs[::2], runs[1::2], strict=True) for i in range(a, b)}
        assert found == {i for i in range(len(s) - 31) if count[s[i : i + 32]] > 1}


def test_equal_strings_have_equal_anchors():
    texts = [x.encode() for x in invented(3)]
    places = collections.defaultdict(set)
    for x in texts:
        t = np.frombuffer(x, np.uint8)
        start, end, at, h = suffixes.contexts(t, np.zeros(len(t), int), 48)
        assert [i for s, e in zip(start, end) for i in range(s, e)] == list(range(max(len(t) - 47, 0)))
        for s, e, a, k in zip(start, end, at, h):
            for i in range(s, e):
                places[x[i : i + 48]].add((int(a) - i, int(k)))
    assert places and all(len(v) == 1 for v in places.values())


@pytest.mark.parametrize(("seed", "most"), [(1, 512), (2, 2), (5, 1)])
def test_removed_stretches(spark, seed, most):
    texts = invented(seed)
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(texts)], DOC).repartition(3)
    got = {r.doc_id: r for r in suffixes.without_repeats(df, 48, most).collect()}
    want = brute([x.encode() for x in texts], 48)
    for i, (x, spans) in enumerate(zip(texts, want, strict=True)):
        assert got[i].spans == spans, (i, x)
        assert (got[i].n_bytes, got[i].n_spans, got[i].n_removed) == (len(x.encode()), len(spans) // 2, len(x.encode()) - len(got[i].kept))
    assert any(want) and not all(want)


def test_long_texts_are_cut_where_strings_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 100)
    texts = [x.encode() for x in invented(7)]
    parts = [p for held in suffixes._cut(texts, 48) for p in held]
    assert collections.Counter((i, o + k) for i, o, x in parts for k in range(len(x) - 47)) == collections.Counter((i, k) for i, x in enumerate(texts) for k in range(len(x) - 47))


def test_odd_rows(spark):
    from tests.llm.test_llm import empty, odd

    rows = suffixes.without_repeats(odd(spark)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == sorted([(7, 0), (0, 0), (7, 0), (0, 0), (4, 0), (7, 0), (200000, 200000), (30000, 30000), (len("Ünï 中文 🙂 ▁ \x00 \r\n".encode()), 0), (0, 0)])
    assert suffixes.without_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_strings([b"a" * 60], 50)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    texts = [(d.text or "").encode() for d in docs]
    want = {}
    for d, x, spans in zip(docs, texts, brute(texts, 400), strict=True):
        edges = [0, *spans, len(x)]
        kept = b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        want[d.doc_id] = (len(x), len(x) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op12_suffix_dedup(spark, sf).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_steps_are_written_tables(spark):
    """The plan of the result doesn't grow with the steps that cut a group."""
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(invented(5))], DOC)
    plan = suffixes.repeated_spans(df, 48, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 6 and "LogicalRDD" not in plan
