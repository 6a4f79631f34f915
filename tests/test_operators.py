"""Graph, story, merge, alert, pipeline and export operators on small fixtures."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import alerts, analytics, commands, evaluation, exports, graph, merge, pipeline, search, stories
from brindle.operators.components import connected_components
from brindle.sources import feeds


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def articles(spark, n=6):
    day = datetime(2024, 1, 1)
    rows = [(i, f"title {i}", f"Alpha met with Beta. Text {i}.", "en", ["pos", "neg", None][i % 3], [0.6, -0.6, None][i % 3], "analyzed", 1 + i % 2, day + timedelta(days=i)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, content string, language string, sentiment_label string, sentiment_score double, status string, source_id long, discovered_at timestamp_ntz")


def mentions(spark, rows):
    return spark.createDataFrame([(a, t, n, s, s + len(t), 0.9, n.split(":")[1], n.split(":")[0], datetime(2024, 1, 1), "analyzed") for a, t, n, s in rows], "article_id long, text string, node string, start long, stop long, confidence double, canonical string, label string, discovered_at timestamp_ntz, status string")


def test_triples_and_edges(spark):
    a = spark.createDataFrame([(1, "Alpha met with Beta. Alpha met with Beta. Gamma is from Delta.")], "id long, content string")
    m = mentions(spark, [(1, "Alpha", "PER:alpha", 0), (1, "Beta", "PER:beta", 15), (1, "Gamma", "PER:gamma", 42), (1, "Delta", "LOC:delta", 56)])
    got = {(r.subject, r.object, r.predicate, r.confidence) for r in graph.relationship_triples(a, m).collect()}
    assert got == {("PER:alpha", "PER:beta", "met_with", 0.72), ("PER:gamma", "LOC:delta", "from", 0.72)}
    assert graph.cooccurrence_edges(m).count() == 6
    assert {r.node: r.degree for r in graph.weighted_degree(graph.cooccurrence_edges(m)).collect()}["PER:beta"] == 3


def test_story_choice(spark):
    t = pd.Timestamp("2024-01-01")
    d = pd.Timedelta(days=1)
    assert [s for _, s, _ in stories.replay([(1, t, {1, 2, 3}, 1.0), (2, t + d, {2, 3, 4}, 0.0), (3, t + d, {9}, None)])] == [1, 1, 3]
    assert [s for _, s, _ in stories.replay([(1, t, {1, 2, 3}, None), (2, t, {3, 4, 5}, None)])] == [1, 2]
    assert [s for _, s, _ in stories.replay([(1, t, {1, 2}, None), (2, t + 9 * d, {1, 2}, None)])] == [1, 2]


def test_story_assignment_by_component_is_the_global_replay(spark):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=rng.randrange(600)), rng.choice([None, 0.5, -0.5]), rng.sample(range(40), rng.randrange(2, 5))) for i in range(120)]
    a = spark.createDataFrame([(i, s, x) for i, s, x, _ in rows], "id long, discovered_at timestamp_ntz, sentiment_score double")
    m = spark.createDataFrame([(i, str(n)) for i, _, _, ns in rows for n in ns], "article_id long, node string")
    got = {r.article_id: r.story_id for r in stories.story_assignment(a, m).collect()}
    assert got == {i: s for i, s, _ in stories.replay([(i, pd.Timestamp(s), map(str, ns), x) for i, s, x, ns in rows])}


def test_merges(spark):
    nodes = spark.createDataFrame([("PER:ana", "ana", "PER", ["Ana"], 5, "Q1"), ("ORG:anna", "anna", "ORG", ["Anna"], 3, "Q1"), ("PER:bob", "bob", "PER", ["Bob"], 2, None)], "node string, canonical string, label string, aliases array<string>, mention_count long, wikidata_id string")
    edges = spark.createDataFrame([("ORG:anna", "PER:bob", 2), ("PER:ana", "PER:bob", 3), ("ORG:anna", "PER:ana", 1)], "a string, b string, weight long")
    triples = spark.createDataFrame([("ORG:anna", "PER:bob", "won", 1, 0.5), ("PER:ana", "PER:bob", "won", 1, 0.4)], "subject string, object string, predicate string, article_id long, confidence double")
    m = mentions(spark, [(1, "Anna", "ORG:anna", 0)])
    mapping = merge.qid_mapping(nodes)
    assert [tuple(r) for r in mapping.collect()] == [("ORG:anna", "PER:ana")]
    assert merge.qid_mapping(nodes, by_label=True).count() == 0
    for combine, weight in (("sum", 5), ("max", 3)):
        out = merge.merge_apply(mapping, nodes, edges, triples, m, combine)
        assert {(r.node, r.mention_count, tuple(r.aliases)) for r in out["nodes"].collect()} == {("PER:ana", 8, ("Ana", "Anna")), ("PER:bob", 2, ("Bob",))}
        assert [tuple(r) for r in out["edges"].collect()] == [("PER:ana", "PER:bob", weight)]
        assert [r.confidence for r in out["triples"].collect()] == [0.5]
        assert out["mentions"].first().node == "PER:ana"
    bare = merge.merge_apply(mapping, nodes, edges, triples, m, repoint=())
    assert bare["triples"].count() == 1 and bare["mentions"].first().node is None
    assert [tuple(r) for r in merge.merge_edges(edges, mapping).select("a", "b").collect()] == [("PER:ana", "PER:bob")]
    assert merge.link_candidates(nodes, 1).first().node == "PER:bob"


def test_similar_pairs(spark):
    names = ["skopje", "skopja", "skoplje", "berlin", "berline", "paris"]
    nodes = spark.createDataFrame([(f"LOC:{n}", n, "LOC", i) for i, n in enumerate(names)], "node string, canonical string, label string, mention_count long")
    pairs = merge.similar_pairs(nodes)
    assert {(r.a, r.b) for r in pairs.collect()} == {("LOC:skopja", "LOC:skopje"), ("LOC:skopje", "LOC:skoplje"), ("LOC:berlin", "LOC:berline")}
    assert {r.node: r.canonical_node for r in merge.clusters(pairs, nodes).collect()} == {"LOC:skopje": "LOC:skoplje", "LOC:skopja": "LOC:skoplje", "LOC:berlin": "LOC:berline"}


def test_disambiguate(spark):
    rows = [("n", "berlin", "LOC", "Q64", "Berlin", "capital city", None, 0), ("n", "berlin", "LOC", "Q1", "Berlin", "band", None, 1), ("m", "x", "LOC", "Q2", "Other", None, ["X"], 0), ("k", "zzz", "PER", "Q3", "Other", "human", None, 0)]
    c = spark.createDataFrame(rows, "node string, canonical string, label string, qid string, name string, description string, aliases array<string>, place int")
    assert {(r.node, r.qid, r.score) for r in merge.disambiguate(c).collect()} == {("n", "Q64", 3.0), ("m", "Q2", 1.5)}


def test_alerts_are_idempotent(spark):
    a = articles(spark)
    rules = spark.createDataFrame([(1, "k", "beta", ["en"], -0.3, None, "both", True), (2, "e", None, None, None, "PER:x", "both", True), (3, "t", "text", None, None, None, "title", True)], alerts.RULES)
    m = mentions(spark, [(2, "X", "PER:x", 0)])
    found = alerts.match(a, rules, m)
    assert {(r.rule_id, r.article_id) for r in found.collect()} == {(1, 1), (1, 4), (2, 2)}
    assert "keyword: beta; language: en; sentiment <= -0.3" in {r.reason for r in found.collect()}
    assert alerts.scan(a, rules, m, found.select("rule_id", "article_id"), None).count() == 0


def test_pipeline(spark):
    rows = spark.createDataFrame([(1, "new", datetime(2024, 1, 1), None, 0), (2, "new", datetime(2024, 1, 2), datetime(2024, 1, 3), 0), (3, "new", datetime(2024, 1, 1), None, 3), (4, "analyzed", datetime(2024, 1, 1), None, 0)], "id long, status string, discovered_at timestamp_ntz, started_at timestamp_ntz, retry_count int")
    assert [r.id for r in pipeline.claimable(rows, "extract", "2024-01-03 00:01:00", 9).collect()] == [1]
    assert [r.id for r in pipeline.claimable(rows, "extract", "2024-01-03 00:06:00", 9).collect()] == [1, 2]
    after = {r.id: (r.status, r.retry_count) for r in pipeline.retry_transition(rows, F.col("id") != 2, "extract").collect()}
    assert after == {1: ("new", 1), 2: ("extracted", 0), 3: ("failed", 4), 4: ("new", 1)}
    known = spark.createDataFrame([("http://a/x",)], "url string").select(pipeline.t.url_hash(F.col("url")).alias("url_hash"))
    e = spark.createDataFrame([("http://a/X/", 1), ("http://a/y", 2), ("http://a/Y", 1)], "url string, seen int")
    assert [(r.url, r.seen) for r in pipeline.dedup_url(e, known).collect()] == [("http://a/Y", 1)]
    c = spark.createDataFrame([(1, "rss", "a"), (1, "homepage", "b"), (2, "sitemap", "c")], "source_id int, channel string, url string")
    assert {r.url for r in pipeline.source_cascade(c).collect()} == {"a", "c"}
    staged = pipeline.analyze_stage(pipeline.extract_stage(articles(spark))).first()
    assert staged.status == "sentiment_done" and staged.language == "en"


def test_commands(spark):
    w = spark.createDataFrame([("a", "x")], "node string, note string")
    with pytest.raises(commands.Conflict):
        commands.add(w, {"node": "a", "note": None}, "node")
    assert commands.add(w, {"node": "b", "note": None}, "node").count() == 2
    with pytest.raises(commands.NotFound):
        commands.remove(w, "node", "z")
    s = spark.createDataFrame([(1, True, False), (2, True, False)], "id long, enabled boolean, deleted boolean")
    assert commands.active_sources(commands.delete_source(s, 1)).count() == 1


def test_credibility(spark):
    a = spark.createDataFrame([(i, 1, s) for i, s in enumerate(["failed", "duplicate", "analyzed", "analyzed"])], "id long, source_id long, status string")
    s = spark.createDataFrame([(1, "s", True, datetime(2024, 1, 1)), (2, "t", True, None)], "id long, name string, enabled boolean, last_scanned_at timestamp_ntz")
    rows = {r.id: r for r in analytics.source_grades(analytics.source_credibility(a, s), "2024-01-01 10:00:00").collect()}
    assert rows[1].reliability == 0.5625 and 50 <= rows[1].score <= 60 and rows[1].grade == "C"
    assert rows[2].total == 0 and rows[2].score == 70.0


def test_search_rank(spark):
    a = spark.createDataFrame([(1, "Скопје", "е главен град", "analyzed", "mk", datetime(2024, 1, 1)), (2, "other", "skopje other skopje", "analyzed", "en", datetime(2024, 1, 2)), (3, "x", "skopje", "duplicate", "en", datetime(2024, 1, 2))], "id long, title string, content string, status string, language string, discovered_at timestamp_ntz")
    for q in ("скопје", "Skopje"):
        hits = {r.id: r.rank for r in search.search(a, search.SearchRequest(q=q)).collect()}
        assert hits == {1: 0.0608, 2: 0.076}
    pair = {r.id: r.rank for r in search.search(a, search.SearchRequest(q="glaven grad")).collect()}
    assert pair == {1: 0.0991}
    assert search.search(a, search.SearchRequest(q="2026")).count() == 2
    assert [r.id for r in search.page(search.search(a, search.SearchRequest()), search.SearchRequest()).collect()] == [2, 1]
    assert search.parse_list("mk, sq ,en") == ["mk", "sq", "en"] and search.parse_list(None) == []
    with pytest.raises(ValueError):
        search.SearchRequest(limit=0)


def test_exports(spark, tmp_path):
    a = articles(spark)
    exports.write_csv(a, ("id", "title", "nothing"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6
    assert '"total":6' in exports.json_envelope(a, "json").first()[0]
    kinds = [r.kind for r in exports.page_blocks(a.where("id = 1")).orderBy("seq").collect()]
    assert kinds == ["title", "meta", "body"]


def test_feeds(spark):
    rss = "<rss><item><title>One</title><link>/a/b</link><description><![CDATA[x]]></description></item><item><title>No link</title></item></rss>"
    got = feeds.rss_entries(spark.createDataFrame([(1, "https://h.org/feed", rss)], "source_id int, source_url string, body string")).collect()
    assert [(r.url, r.title, r.summary) for r in got] == [("https://h.org/feed/a/b", "One", "x")]
    urls = feeds.sitemap_urls(spark.createDataFrame([(1, "<loc>https://h/news/1</loc><loc>https://h/about</loc>")], "source_id int, body string"))
    assert [r.url for r in urls.collect()] == ["https://h/news/1"]
    assert feeds.page_links('<a href="/long/enough/path">T <b>x</b></a><a href="/tag/aaaaaaaaaa">no</a><a href="/s">no</a>', "https://h.org/") == [("https://h.org/long/enough/path", "T x")]
    page = "<html><head><title>T</title><meta name=author content=Me></head><body><nav><li>menu</li></nav><article><p>" + "word " * 20 + "</p><h2>More</h2></article></body></html>"
    x = feeds.extracted(page)
    assert x["author"] == "Me" and x["word_count"] == 21 and "menu" not in x["content"]
    assert feeds.extracted("<p>short</p>") is None and feeds.extracted(None) is None


@pytest.mark.parametrize("url,ok", [("http://localhost/", False), ("http://127.0.0.1/", False), ("ftp://a.org/", False), ("http://u:p@a.org/", False), ("http://10.1.1.1/x", False), ("http://169.254.169.254/", False), ("https://93.184.216.34/", True), ("https://a.org/x", True)])
def test_url_guard(spark, url, ok):
    assert feeds.url_allowed(url) is ok
    assert spark.createDataFrame([(url,)], "u string").select(feeds.url_shape_allowed(F.col("u"))).first()[0] is ok
    assert feeds.url_allowed("http://a.org/", lambda h: ["10.0.0.1"]) is False


def test_evaluation(spark):
    g = spark.createDataFrame([(1, "en", 0, 5, "PER"), (1, "en", 10, 15, "LOC")], "id long, lang string, start int, stop int, type string")
    p = spark.createDataFrame([(1, "en", 0, 5, "PER"), (1, "en", 11, 15, "LOC")], "id long, lang string, start int, stop int, type string")
    total = evaluation.ner_prf(g, p).where("lang is null and type is null").first()
    assert (total.tp, total.fp, total.fn, total.f1) == (1, 1, 1, 0.5)
    assert evaluation.macro_f1(evaluation.ner_prf(g, p)).first()[0] == 0.5
    assert {(r.type, r.tp, r.fp, r.fn) for r in evaluation.relaxed_matches(g, p).collect()} == {("PER", 1, 0, 0), ("LOC", 1, 0, 0)}
    t = evaluation.throughput(spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0)], "replica_count int, articles_per_min double"))
    assert {r.replica_count: (r.mean, r.std, r.speedup) for r in t.collect()} == {1: (15.0, 5.0, 1.0), 2: (30.0, 0.0, 2.0)}
    m = evaluation.merge_shares(spark.createDataFrame([("s", "correct_merge"), ("s", "false_merge"), ("s", None)], "strategy string, label string")).first()
    assert (m.correct_merge, m.false_merge) == (50.0, 50.0)


def test_rank_of_mixed_groups(spark):
    """The outermost operator decides: alternatives are ranked by all of their words, whatever stands within them; hand values."""
    a = spark.createDataFrame([(1, "", "alpha beta gamma"), (2, "", "alpha alpha beta"), (3, "", "gamma gamma"), (4, "", "alpha")], "id long, title string, content string")
    a = a.selectExpr("*", "'analyzed' as status", "'en' as language", "timestamp_ntz'2024-01-01' as discovered_at")
    hits = {r.id: r.rank for r in search.search(a, search.SearchRequest(q="alpha beta or gamma")).collect()}
    once, twice = 0.1 / 1.64493406685, (0.1 + 0.1 / 4) / 1.64493406685
    assert hits == {1: round(3 * once / 3, 4), 2: round((twice + once) / 3, 4), 3: round(twice / 3, 4)}
    told = search.scored(a, search.SearchRequest(q="alpha beta or gamma"))
    assert {r.id: r.rank for r in told.collect()} == hits and "content" not in told.columns
