"""The threshold keeps the share of bad labels, however many labelled rows are sampled."""

import random

import numpy as np

from brindle.llm import quality_ranking


def test_threshold_of_a_balanced_sample():
    rng = np.random.default_rng(1)
    good = np.array([True] * 3000 + [False] * 3000)
    rows = np.where(good, rng.normal(1.0, 1.0, 6000), rng.normal(0.0, 1.0, 6000))[:, None]  # the classes overlap
    ranking = quality_ranking.fit(rows, good, totals=(3000, 27000))
    low = ranking.scores(rows) < 0.5
    share = (low[~good].mean() * 3000 + low[good].mean() * 27000) / 30000
    assert abs(share - 0.1) < 0.005  # unweighted: 0.5 of the sample lies below
    whole = quality_ranking.fit(rows, good)
    assert quality_ranking.fit(rows, good, totals=(3000, 3000)) == whole and abs((whole.scores(rows) < 0.5).mean() - 0.5) < 0.005


def test_learnt_share_above_the_cap(spark):
    rng = random.Random(2)
    texts = []
    for i in range(1500):
        bad = i % 10 == 0
        loud = rng.random() * (1.0 if bad else 0.7)  # overlapping shares of words with marks
        texts.append((i, " ".join(f"word{rng.randrange(400)}" + "!" * (rng.random() < loud) for _ in range(60)), int(not bad)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, quality int").repartition(3).cache()
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "quality").union(spark.createDataFrame([(-k, 0) for k in range(1, 4000)], "doc_id long, quality int"))
    learnable = frame.where(~quality_ranking.held_out())
    share = learnable.where("quality = 0").count() / learnable.count()
    for most in (60, quality_ranking.MOST_LABELLED):
        ranking = quality_ranking.learn(docs, labels, most_labelled=most)
        scored = quality_ranking.score(learnable, ranking)
        assert abs(scored.where("score < 0.5").count() / scored.count() - share) < 0.05
