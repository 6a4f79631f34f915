"""Stories are assigned from the names of whole texts."""

import random
import re

import pandas as pd
import pytest

from brindle.operators import stories
from brindle.operators.stories import replay
from brindle.plans.registry import QUERIES
from brindle.sources.views import NAME, Views

SF = "/root/testdata/sf0.001"


def test_assignment_reads_whole_texts(spark):
    articles = Views(spark, SF).visible.collect()
    # nodes carry the label, which follows from the length
    nodes = {r.id: {f"{('PER', 'ORG', 'LOC')[len(x) % 3]}:{x.lower()}" for x in re.findall(NAME, r.content)} for r in articles}
    want = replay([(r.id, r.discovered_at, nodes[r.id], r.sentiment_score) for r in articles if nodes[r.id]])
    got = [tuple(r) for r in QUERIES["story_assignment"](spark, SF).collect()]
    assert sorted((a, s) for a, s, _ in got) == sorted((a, s) for a, s, _ in want)


def chained(seed, n, nodes, hours):
    """Articles whose sets change little by little, so that decisions hang on each other."""
    r, t, out = random.Random(seed), pd.Timestamp("2024-03-01"), []
    now = [set(r.sample(range(nodes), 4)) for _ in range(3)]
    for i in range(n):
        t += pd.Timedelta(hours=r.choice([0, 1, hours]))
        k = r.randrange(3)
        if r.random() < 0.6:
            now[k] = (set(list(now[k])[1:]) | {r.randrange(nodes)}) if r.random() < 0.7 else set(r.sample(range(nodes), r.randint(1, 6)))
        out.append((n - i if seed % 2 else i, t.to_pydatetime(), sorted(now[k]), r.choice([None, 0.5, -0.25])))
    return out


@pytest.mark.parametrize(("seed", "n", "nodes", "hours"), [(1, 120, 14, 20), (2, 120, 40, 60)])
def test_rounds_end_at_the_replay(spark, seed, n, nodes, hours):
    rows = chained(seed, n, nodes, hours)
    articles = spark.createDataFrame([(i, t, s) for i, t, _, s in rows], "id long, discovered_at timestamp_ntz, sentiment_score double").repartition(3)
    members = spark.createDataFrame([(i, f"n{x}") for i, _, xs, _ in rows for x in xs * 2], "article_id long, node string")
    want = sorted(replay([(i, pd.Timestamp(t), {f"n{x}" for x in xs}, s) for i, t, xs, s in rows]))
    got = sorted(tuple(r) for r in stories.story_assignment(articles, members).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want
    assert len({s for _, s, _ in want}) < 0.9 * n


def test_odd_articles(spark):
    day = pd.Timestamp("2024-03-01").to_pydatetime()
    articles = spark.createDataFrame([(1, day, 0.5), (2, day, 0.1), (2, day, 0.1), (3, None, 0.5), (None, day, 0.5), (5, day, None)], "id long, discovered_at timestamp_ntz, sentiment_score double")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (None, "a"), (5, None), (9, "a")], "article_id long, node string")
    assert sorted(map(tuple, stories.story_assignment(articles, members).collect())) == [(1, 1, 0.5), (2, 1, 0.3)]
    assert stories.story_assignment(articles.limit(0), members.limit(0)).count() == 0


def test_no_group_of_all_articles(spark):
    plan = stories.assignments(Views(spark, SF).articles, Views(spark, SF).mentions)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "CartesianProduct" not in plan


def test_backfill_is_the_assignment_recomputed(spark):
    found = {r.story_id: r for r in QUERIES["story_backfill"](spark, SF).collect()}
    sizes = {}
    for r in QUERIES["story_assignment"](spark, SF).collect():
        sizes[r.story_id] = sizes.get(r.story_id, 0) + 1
    assert {s: r.member_count for s, r in found.items()} == sizes


def test_answers_by_name(spark):
    nodes = spark.createDataFrame([("PER:anna", "anna", "PER", 1), ("LOC:annaba", "annaba", "LOC", 9)], "node string, canonical string, label string, mention_count long")
    day = pd.Timestamp("2024-03-01").to_pydatetime()
    rows = spark.createDataFrame([(1, "en", "pos", ["LOC:annaba"], day), (2, "en", None, ["PER:anna"], day)], "story_id long, dominant_language string, dominant_sentiment string, nodes array<string>, last_seen timestamp_ntz")
    held = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "story_id long, article_id long")
    summaries = spark.createDataFrame([(5, "a"), (6, "longer"), (7, None)], "article_id long, summary string")
    assert stories.named_node(nodes, "ANNA") == "LOC:annaba" and stories.named_node(nodes, "zzz") is None
    got = stories.answer(rows, held, summaries, nodes, entity="Anna").collect()
    assert [(r.story_id, r.summary, [tuple(e) for e in r.entities]) for r in got] == [(1, "longer", [("annaba", "LOC")])]
    assert stories.answer(rows, held, summaries, nodes, entity="zzz").count() == 0 and stories.answer(rows, held, summaries, nodes, "EN", "POS").count() == 1
    with pytest.raises(ValueError):
        stories.answer(rows, held, summaries, nodes, limit=0)


def test_only_answered_stories_are_gathered(spark):
    day = lambda n: pd.Timestamp(f"2024-03-0{n}").to_pydatetime()
    held = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (5, 5), (5, 6), (7, 7)], "story_id long, article_id long")
    articles = spark.createDataFrame([(i, day(d)) for i, d in ((1, 1), (2, 5), (3, 2), (4, 3), (5, 9), (6, 9), (7, 5))], "id long, discovered_at timestamp_ntz")
    members = spark.createDataFrame([(1, "x"), (1, "x"), (4, "x"), (5, "y"), (7, "x"), (8, "x")], "article_id long, node string")
    got = lambda node, limit: sorted(map(tuple, stories.newest_of_node(held, articles, members, node, limit).collect()))
    assert got("x", 2) == [(1, 1), (1, 2), (7, 7)] and got("x", 50) == [(1, 1), (1, 2), (3, 3), (3, 4), (7, 7)] and got(None, 5) == got("z", 5) == []
    plan = QUERIES["stories_answer"](spark, SF)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan  # texts are read for what is written before, not again for each use
