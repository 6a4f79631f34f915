"""Pairs of sets that many have, and spans of many small groups, against brute force."""

import random

from brindle.operators import evaluation, stories


def test_equal_sets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(stories, "MEMBERS", 3)
    monkeypatch.setattr(stories, "MADE", 10)
    r = random.Random(4)
    bag = [tuple(r.sample("abcdefgh", r.randint(1, 4))) for _ in range(9)]
    sets = {i: set(r.choice(bag)) for i in range(60)}
    rows = [(i, x) for i, s in sets.items() for x in s] + [(0, None), (90, None), (91, None), (None, "a")]
    got = [(x.a, x.b, x.shared, x.jaccard) for x in stories.jaccard_pairs(spark.createDataFrame(rows, "article_id long, node string")).collect()]
    want = [(a, b, len(x & y), round(len(x & y) / len(x | y), 4)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.5]
    assert sorted(got) == sorted(want) and len(want) > 200


def greedy(g, p, least=0.5):
    free, tp = set(range(len(g))), 0
    for a, b in p:
        top = max((((min(b, g[i][1]) - max(a, g[i][0])) / (max(b, g[i][1]) - min(a, g[i][0])), -i) for i in free), default=(0.0, 0))
        if top[0] > least:
            free.discard(-top[1])
            tp += 1
    return tp, len(p) - tp, len(g) - tp


def test_relaxed_matches_take_groups_in_one_pass(spark):
    r = random.Random(5)
    made = lambda n: [(r.choice([None, 1, 2, 3]), r.choice(["PER", "LOC", None]), a, a + r.randint(1, 12)) for a in (r.randint(0, 80) for _ in range(n))]
    g, p = made(120), made(120)
    frames = [spark.createDataFrame(x, "id long, type string, start long, stop long").repartition(3) for x in (g, p)]
    found = evaluation.relaxed_matches(*frames)
    own = lambda x, k: sorted((a, b) for i, t, a, b in x if (i, t) == k)
    want = {k: greedy(own(g, k), own(p, k)) for k in {x[:2] for x in g + p}}
    assert {(x.id, x.type): (x.tp, x.fp, x.fn) for x in found.collect()} == want
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # a call for each group
