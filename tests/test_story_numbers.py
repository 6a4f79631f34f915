"""Names are shuffled as numbers while stories are assigned, with the same result as by a replay."""

from datetime import datetime

from brindle.operators import stories


def test_names_are_numbered(spark):
    rows = [(i, datetime(2024, 1, 1 + i)) for i in range(4)]
    sets = {0: "abc", 1: "abcd", 2: "xy", 3: "bcd"}
    a = spark.createDataFrame([(i, at, None) for i, at in rows], "id long, discovered_at timestamp_ntz, sentiment_score double")
    m = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "article_id long, node string")
    assert dict(stories._rare_first(m, a, True).dtypes)["nodes"] == "array<bigint>"
    got = {r.article_id: r.story_id for r in stories.assignments(a, m).collect()}
    assert got == {i: s for i, s, _ in stories.replay([(i, at, sets[i], None) for i, at in rows])} == {0: 0, 1: 0, 2: 2, 3: 0}
