"""Queries that SQL doesn't say, against plain Python over the smallest tables; null texts; and what plans shuffle."""

import collections
import re
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as t
from brindle.functions.values import ENTITY_LABELS, PREDICATES
from brindle.operators import alerts, commands, evaluation, graph, merge, pipeline, search, stories
from brindle.plans.registry import QUERIES
from brindle.sources import feeds
from brindle.sources.versions import Store
from brindle.sources.views import NAME, Views
from brindle.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def names(texts):
    """article -> {name: first place}"""
    return {i: {m: x.index(m) for m in re.findall(NAME, x)} for i, x in texts.items()}


def node(name):
    return f"{('PER', 'ORG', 'LOC')[len(name) % 3]}:{name.lower()}"


def plain(text):
    from tests.test_text import plain as rule

    return rule(text)


def test_components(spark, names):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for found in names.values():
        nodes = sorted({node(n) for n in found})
        for a, b in zip(nodes, nodes[1:], strict=False):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.component for r in QUERIES["entity_components"](spark, SF).collect()}
    assert got == {x: top(x) for x in root}


def test_communities_and_their_summary(spark):
    v = Views(spark, SF)
    rng = [("a", 6), ("b", 6), ("c", 5)]
    edges = [(f"{g}{i}", f"{g}{j}", 3) for g, n in rng for i in range(n) for j in range(i + 1, n)] + [("a0", "b0", 1), ("b1", "c1", 1), ("x", "y", 1)]
    members = graph.propagated(spark.createDataFrame(edges, "a string, b string, weight long"))
    by = collections.defaultdict(set)
    for r in members.collect():
        by[r.community].add(r.node)
    assert sorted(map(len, by.values())) == [2, 5, 6, 6] and all(len({n[0] for n in s}) == 1 for s in by.values() if len(s) > 2)
    of = {n: k for k, s in by.items() for n in s}
    total = 2 * sum(w for _, _, w in edges)
    degree = collections.Counter()
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
    want = sum(2 * w for a, b, w in edges if of[a] == of[b]) / total - sum(sum(degree[n] for n in s) ** 2 for s in by.values()) / total**2
    assert graph.modularity(spark.createDataFrame(edges, "a string, b string, weight long"), members).first()[0] == pytest.approx(want)
    nodes = spark.createDataFrame([(n, hash(n) % 7) for n in of], "node string, mention_count long")
    rows = graph.cluster_summary(members, nodes).collect()
    counts = {r.node: r.mention_count for r in nodes.collect()}
    assert [(r.size, r.heaviest) for r in rows] == [(len(by[r.community]), min(by[r.community], key=lambda n: (-counts[n], n))) for r in rows] and [r.size for r in rows] == sorted((r.size for r in rows), reverse=True)
    with pytest.raises(RuntimeError):
        graph.propagated(v.edges, most_rounds=1)


def split(text):
    return [x for x in (s.strip(" ") for s in re.split(r"(?<=[.!?])\s+|\n+", text)) if x]


def test_relationship_triples(spark, texts, names):
    phrases = "|".join(sorted(PREDICATES, key=lambda p: -len(p)))
    want = {}
    for i, text in texts.items():
        for s in sorted(set(split(text)), key=text.index):
            s0 = text.index(s)
            inside = sorted((p, n) for n, p in names[i].items() if s0 <= p < s0 + len(s))
            for p, a in inside:
                for q, b in inside:
                    if q >= p + len(a) and (hit := re.search(phrases, plain(text[p + len(a) : q]))):
                        confidence = round(min(0.5 + len(a) % 5 / 10, 0.5 + len(b) % 5 / 10, 1.0) * 0.8, 3)
                        want.setdefault((node(a), node(b), PREDICATES[hit[0]], i), confidence)
    got = {(r.subject, r.object, r.predicate, r.article_id): r.confidence for r in QUERIES["relationship_triples"](spark, SF).collect()}
    assert want and got == pytest.approx(want)


def test_similarity_scores(spark, names):
    from brindle.functions.values import SUFFIXES

    def base(s):
        for x in sorted(SUFFIXES, key=len):
            if s.endswith(x) and len(s) - len(x) >= 4:
                return s[: -len(x)]
        return s

    def score(a, b):
        if a == b or base(a) == base(b):
            return 1.0
        return 0.95 if b == base(a) or a == base(b) else SequenceMatcher(None, a, b).ratio()

    nodes = {node(n) for f in names.values() for n in f}
    by = collections.defaultdict(list)
    for n in nodes:
        label, name = n.split(":")
        by[label, name[:5]].append(name)
    want = {(k[0], a, b): round(score(a, b), 4) for k, group in by.items() for a in group for b in group if a < b}
    got = {(r.label, r.a, r.b): r.similarity for r in QUERIES["entity_similarity_scores"](spark, SF).collect()}
    assert want and got == pytest.approx(want, abs=1e-4)
    pairs = {(r.a, r.b) for r in merge.similar_pairs(Views(spark, SF).nodes).collect()}
    near = {(a, b) for a in nodes for b in nodes if a < b and a.split(":")[0] == b.split(":")[0] and a.split(":")[1][0] == b.split(":")[1][0] and abs(len(a) - len(b)) <= 2 and score(a.split(":")[1], b.split(":")[1]) >= 0.8}
    assert pairs == near


def brute_summary(text, most=220):
    every = [x for x in (s.strip(" ") for s in re.split(r"(?<=[.!?…])\s+|\n+", text)) if x]
    if sum(map(len, every)) <= most:
        return " ".join(every)
    value = lambda i: 1 - i / len(every) - (0 if 40 <= len(every[i]) <= 220 else 0.4)
    taken, used = [], 0
    for i in sorted(range(len(every)), key=lambda i: (-value(i), i)):
        if used and used + len(every[i]) + 1 > most:
            break
        taken.append(every.index(every[i]))
        used += len(every[i]) + 1
    return " ".join(every[i] for i in sorted(taken))


def test_summaries_and_stages(spark, texts):
    got = {r.id: r.summary for r in QUERIES["extractive_summary"](spark, SF).collect()}
    assert got == {i: brute_summary(x) for i, x in texts.items()}
    rows = {r.id: r for r in QUERIES["extract_stage"](spark, SF).collect()}
    assert all(rows[i].summary == got[i] and rows[i].word_count == len(x.split()) and rows[i].status == "extracted" for i, x in texts.items())
    done = {r.id: r for r in QUERIES["analyze_stage"](spark, SF).collect()}
    assert len(done) == len(texts) and {r.status for r in done.values()} == {"sentiment_done"}
    assert all(r.sentiment_label == ("pos" if r.sentiment_score >= 0.05 else "neg" if r.sentiment_score <= -0.05 else "neutral") for r in done.values())


def test_spans(spark, texts, names):
    got = collections.defaultdict(list)
    for r in QUERIES["resolve_mention_spans"](spark, SF).collect():
        got[r.id].append((r.start, r.stop, r.surface))
    for i, text in texts.items():
        pattern = "|".join(map(re.escape, sorted(names[i], key=lambda n: -len(n))))
        assert sorted(got[i]) == ([(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)] if pattern else [])


def test_semantic_search(spark, texts):
    from tests.test_text import hashed

    v = Views(spark, SF)
    query = hashed("the terms of a license")
    rows = {r.id: r for r in v.articles.collect()}
    value = {i: sum(a * b for a, b in zip(query, hashed(r.title), strict=True)) for i, r in rows.items() if r.status == "analyzed" and r.language == "en"}
    best = sorted((i for i in value if value[i] > 1e-12), key=lambda i: -value[i])[:20]
    got = QUERIES["semantic_search"](spark, SF).collect()
    assert [r.score for r in got] == pytest.approx([value[i] for i in best], abs=1e-4)
    with pytest.raises(ValueError):
        search.semantic_search(v.articles, v.sources, " a ")


def test_pages(spark):
    ld = '<script type="application/ld+json">{"headline": "H", "articleBody": "%s", "author": {"name": "Me"}}</script>' % ("word " * 20)
    html = "<html><title>%s</title><p class='Big-Author'>By <b>Ana</b></p><p>%s</p></html>" % ("t" * 600, "text " * 20)
    pages = spark.createDataFrame([(1, ld), (2, html), (3, "<p>x</p>"), (4, None), (5, "<script type='application/ld+json'>{broken</script>")], "page_id long, html string")
    rows = {r.page_id: r for r in feeds.extraction_cascade(feeds.primary_extract(pages), feeds.html_extract(pages)).collect()}
    assert (rows[1].title, rows[1].author, rows[1].word_count) == ("H", "Me", 20)
    assert len(rows[2].title) == 500 and rows[2].author == "ByAna" and rows[3].error and rows[4].error and rows[5].error
    dates = {"Mon, 01 Jan 2024 02:30:00 +0200": datetime(2024, 1, 1, 0, 30), "Tue, 2 Jan 24 10:00 EST": datetime(2024, 1, 2, 15), "2024-01-03T04:05:06Z": datetime(2024, 1, 3, 4, 5, 6), "2024-01-03T04:05:06+01:00": datetime(2024, 1, 3, 3, 5, 6), "never": None}
    got = spark.createDataFrame([(d,) for d in dates], "d string").select("d", feeds.feed_time(F.col("d")).alias("x")).collect()
    assert {r.d: r.x for r in got} == dates
    names = spark.createDataFrame([("a &amp;lt; &#38; &#x1F642; &copy; &",)], "x string").select(feeds.unescaped(F.col("x"))).first()[0]
    assert names == "a &lt; & 🙂 &copy; &"


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string").coalesce(1)
    feeds.write_jsonl(rows, str(tmp_path / "j"), "made here")
    assert any("made here" in p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert sorted(map(tuple, feeds.read_jsonl(spark, str(tmp_path / "j"), "id long, x string").collect())) == [(1, "a"), (2, None)]
    (tmp_path / "c.csv").write_text("# a comment\na_id,label\n1,ambiguous\n")
    assert feeds.read_labelled_csv(spark, str(tmp_path / "c.csv"), "a_id long, label string").first().label == "ambiguous"


def test_intake_and_keys(spark):
    rows = [(1, "x", "Скопје", "city", 0, 6, 0.61234), (1, "x", "Скопје", "city", 0, 6, 0.61234), (1, "x", "Ana", "Person", 9, 12, 0.2), (1, "x", "Bob", "gadget", 4999, 5002, 0.9), (1, "x", "Eve", "gadget", 20, 23, 0.9), (2, " ", "Ana", "person", 0, 3, 0.9), (1, "x", "12", "date", 30, 32, 0.9), (1, "x", "Zed", None, 40, 43, 0.9)]
    got = graph.intake(spark.createDataFrame(rows, "article_id long, content string, text string, label string, start long, stop long, score double")).collect()
    assert sorted((r.node, r.confidence) for r in got) == [("GADGET:eve", 0.9), ("LOC:skopje", 0.6123), ("MISC:zed", 0.9)]
    assert set(ENTITY_LABELS.values()) == {"PER", "ORG", "LOC", "MISC", "DATE", "EVENT"}


def test_arrays_and_resets(spark):
    rows = spark.createDataFrame([([3, 1, 2], 1, 9), ([3, 1, 9], 1, 9), ([4], 1, 9), (None, 1, 9)], "nodes array<long>, gone long, canonical long")
    got = [r[0] for r in rows.select(stories.replace_node(F.col("nodes"), F.col("gone"), F.col("canonical"))).collect()]
    assert got == [[2, 3, 9], [3, 9], [4], None]
    a = spark.createDataFrame([(1, "analyzed", datetime(2024, 1, 1), 2, "e"), (2, "failed", None, 3, None)], "id long, status string, started_at timestamp_ntz, retry_count int, error_message string")
    ids = spark.createDataFrame([(1,), (1,), (7,)], "id long")
    assert sorted(tuple(r) for r in pipeline.reset(a, ids).collect()) == [(1, "sentiment_done", None, 0, None), (2, "failed", None, 3, None)]
    with pytest.raises(ValueError):
        pipeline.reset(a, ids, "nowhere")
    assert [r[0] for r in a.select(pipeline.valid_status(F.col("status"))).collect()] == [True, True]


def test_running_mean_counts_members_without_a_score():
    day = datetime(2024, 1, 1)
    assert [m for _, _, m in stories.replay([(1, day, {1, 2}, None), (2, day, {1, 2}, 0.8), (3, day, {1, 2}, None), (4, day, {1, 2}, 0.4)])] == [None, 0.4, 0.4, 0.4]


def test_silence_cuts_a_component(spark):
    rows = [(i, datetime(2024, 1, 1 + 9 * (i // 3)), 0.5, ["n", "m"]) for i in range(9)]
    a = spark.createDataFrame([(i, s, x) for i, s, x, _ in rows], "id long, discovered_at timestamp_ntz, sentiment_score double")
    m = spark.createDataFrame([(i, n) for i, _, _, ns in rows for n in ns], "article_id long, node string")
    got = {r.article_id: r.story_id for r in stories.story_assignment(a, m).collect()}
    assert got == {i: i // 3 * 3 for i in range(9)}


def test_null_texts_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A title of Things\n" + "word " * 20, "en", "src1", 120), (2, None, "de", "src1", 0), (3, None, None, "src2", None), (4, "A title of Things\n" + "word " * 20 + "  \t", "en", "src2", 121), (5, "short", "en", "src1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r.id: (r.status, r.duplicate_of_id) for r in Views(spark, str(tmp_path)).articles.collect()}
    assert rows == {1: ("analyzed", None), 2: ("analyzed", None), 3: ("duplicate", 2), 4: ("duplicate", 1), 5: ("failed", None)}
    for name in ("normalize_text", "word_count", "extractive_summary", "status_counts", "language_mix", "search_ranked", "cooccurrence_edges"):
        assert QUERIES[name](spark, str(tmp_path)).count() >= (5 if name in ("normalize_text", "word_count", "extractive_summary") else 0)


SLIM = ["word_count", "normalize_text", "tokenize", "sentiment_over_time", "status_counts", "cooccurrence_edges", "search_ranked", "search_match", "search_page", "extract_stage", "analyze_stage", "source_content_stats", "alert_match", "alerts_list", "export_search"]


def exchanged(df):
    """The columns that each exchange of a plan gets."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"(\w+)#\d+", columns)) for columns in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)]


@pytest.mark.parametrize("name", SLIM)
def test_no_text_is_shuffled(spark, name):
    found = exchanged(QUERIES[name](spark, SF))
    assert not any(columns & {"content", "tokens", "html"} for columns in found)
    assert bool(found) == (name not in ("word_count", "normalize_text", "tokenize", "extract_stage", "analyze_stage"))


def test_shuffled_texts_are_seen(spark):
    texts = Views(spark, SF).texts
    assert any("content" in columns for columns in exchanged(texts.repartition("id").select(F.length("content"))))


def test_long_articles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "NODES", 8)
    rows = [(1, f"n{i:02d}") for i in range(50)] + [(2, "n01"), (2, "n02"), (3, "n07")]
    got = {(r.a, r.b): r.weight for r in graph.cooccurrence_edges(spark.createDataFrame(rows, "article_id long, node string")).collect()}
    want = collections.Counter((f"n{i:02d}", f"n{j:02d}") for i in range(50) for j in range(i + 1, 50))
    want["n01", "n02"] += 1
    assert got == dict(want)


@pytest.mark.parametrize("sent", [10_000, 0])
def test_many_rules(spark, monkeypatch, sent):
    monkeypatch.setattr(alerts, "MOST_SENT", sent)
    monkeypatch.setattr(alerts, "RULES_A_ROW", 7)
    a = spark.createDataFrame([(i, f"t{i}", f"word{i} b_t", "en" if i % 2 else None, None) for i in range(40)], "id long, title string, content string, language string, sentiment_score double")
    rules = [(i, "r", f"word{i}", ["en"] if i % 3 == 0 else None, None, None, "both", True) for i in range(60)] + [(100, "r", "b_t", None, None, None, "content", True), (101, "r", "b%t", None, None, None, "title", True), (102, "r", "t1_", None, None, None, "title", True)]
    none = spark.createDataFrame([], "article_id long, node string")
    got = {(r.rule_id, r.article_id) for r in alerts.match(a, spark.createDataFrame(rules, alerts.RULES), none).collect()}
    want = {(k, i) for k in range(60) for i in range(40) if f"word{i}".startswith(f"word{k}") and (k % 3 or i % 2)} | {(100, i) for i in range(40)} | {(102, i) for i in range(10, 20)}
    assert got == want


def test_small_reports(spark):
    rows = spark.createDataFrame([("web", 100.0), ("web", 103.0), ("ner", 5.0)], "service string, memory_mb double")
    assert {r.service: (r.peak, r.mean) for r in evaluation.resource_peaks(rows).collect()} == {"web": (103.0, 101.5), "ner": (5.0, 5.0)}
    marks = spark.createDataFrame([(1, False), (2, False)], "id long, read boolean")
    assert commands.mark_read(marks, 1).where("read").count() == 1 and commands.mark_read(marks).where("read").count() == 2


def test_recognition_as_one_batch(spark, tmp_path):
    rows = [(i, "t", "Alpha met with Beta. More text.", "en", 0.5, datetime(2024, 1, 1 + i)) for i in range(4)]
    a = spark.createDataFrame(rows, "id long, title string, content string, language string, sentiment_score double, discovered_at timestamp_ntz")
    a.repartition(2).write.parquet(str(tmp_path / "in"))

    def recognise(df):
        made = F.explode(F.array(*[F.struct(F.lit(n).alias("text"), F.lit("person").alias("label"), F.lit(p).cast("long").alias("start"), F.lit(p + len(n)).cast("long").alias("stop"), F.lit(0.9).alias("score")) for n, p in (("Alpha", 0), ("Beta", 15))]))
        return df.select(F.col("id").alias("article_id"), "content", made.alias("m")).select("article_id", "content", "m.*")

    for again in range(2):  # run anew, a batch adds nothing
        jobs.recognition_stream(jobs.stream_of(spark, str(tmp_path / "in"), a.schema), recognise, str(tmp_path / "out"), str(tmp_path / f"cp{again}")).awaitTermination()
    out = Store(spark, str(tmp_path / "out")).read
    assert {(r.node, r.mention_count) for r in out("nodes").collect()} == {("PER:alpha", 4), ("PER:beta", 4)}
    assert out("edges").first().weight == 4 and {r.predicate for r in out("triples").collect()} == {"met_with"}
    assert out("triples").count() == 4 and {r.story_id for r in out("story_articles").collect()} == {0} and out("states").count() == 4


def test_stream_of_a_stage_and_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    query = jobs.stage_stream(jobs.stream_of(spark, str(tmp_path / "in"), jobs.EVENTS), lambda df: df.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    jobs.drained(query)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    assert jobs.sessions(events).agg(F.sum("n")).first()[0] == events.count()
    assert t.sentences(F.lit("a")) is not None


def test_search_in_a_loaded_index(spark):
    from brindle.operators import index

    v = Views(spark, SF)
    loaded = index.loaded(index.postings(search.with_tokens(v.visible)), 4)
    for words in (["reason"], ["that", "with"], ["nowhereatall"], []):
        got = index.search_one(loaded, words)
        wanted = search.with_tokens(v.visible).where(search.matches(F.col("tokens"), [words])) if words else v.visible.limit(0)
        ids = {r.id for r in wanted.select("id").collect()}
        rows = got.collect()
        assert {r.id for r in rows} <= ids and len(rows) == min(20, len(ids))
        assert [(-r.rank, r.id) for r in rows] == sorted((-r.rank, r.id) for r in rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not words or "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0]
    one = {r.id: r.rank for r in index.search_one(loaded, ["that"], 10**6).collect()}
    many = {r.id: r.rank for r in index.search_many(loaded, spark.createDataFrame([(0, ["that"])], "query_id long, terms array<string>")).collect()}
    assert one and one == many
    loaded.unpersist()


def test_guarded_fetch():
    public = lambda host: ["93.184.216.34"] if host != "inner.org" else ["10.0.0.1"]
    pages = {"https://a.org/": (302, {"location": "/b"}, []), "https://a.org/b": (200, {"content-type": "text/html; charset=latin-1"}, ["é".encode("latin-1"), b"x"]), "https://c.org/": (302, {"location": "http://inner.org/"}, []), "https://d.org/": (302, {"location": "https://d.org/"}, []), "https://e.org/": (200, {}, [b"x" * 600] * 3)}
    seen = []

    def get(url, address):
        seen.append((url, address))
        return pages[url]

    answer = feeds.guarded_fetch("https://a.org/", get, public)
    assert feeds.decoded_body(*answer) == "éx" and seen == [("https://a.org/", "93.184.216.34"), ("https://a.org/b", "93.184.216.34")]
    for url in ("https://c.org/", "https://d.org/", "https://u:p@a.org/", "http://127.0.0.1/"):
        with pytest.raises(feeds.Refused):
            feeds.guarded_fetch(url, get, public)
    with pytest.raises(feeds.Refused):
        feeds.guarded_fetch("https://e.org/", get, public, most_bytes=1000)
    assert feeds.decoded_body(404, {}, b"x") is None and feeds.decoded_body(200, {"content-type": "text/html; charset=nonsense"}, b"ok") == "ok"
    assert feeds.decoded_body(200, {}, '<?xml version="1.0" encoding="iso-8859-1"?>é'.encode("latin-1")).endswith("é")
