"""Versions of tables: what readers see, who comes second, and commands over them."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import commands
from brindle.sources.versions import Append, Behind, Buckets, Conflict, NotFound, Store, bucket_of


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, n long")


def told(df):
    return sorted(map(tuple, df.collect()))


def test_two_writers_one_conflict_and_one_version_for_a_reader(spark, store):
    first = store.commit(store.latest(), {"a": rows(spark, ("x", 1)), "b": rows(spark, ("y", 1))})
    base = store.latest()
    assert base.number == first.number == 1
    second = store.commit(base, {"a": rows(spark, ("x", 2)), "b": rows(spark, ("y", 2))})
    with pytest.raises(Behind):
        store.commit(base, {"a": rows(spark, ("x", 9))})
    assert told(store.read("a", first)) == [("x", 1)] and told(store.read("b", first)) == [("y", 1)]
    assert told(store.read("a", second)) == told(store.read("a")) == [("x", 2)]
    assert store.latest().number == 2 and store.version(1) == first
    with pytest.raises(NotFound):
        store.read("c")
    with pytest.raises(NotFound):
        store.version(7)


def test_a_change_is_made_anew_after_another(spark, store):
    store.commit(store.latest(), {"a": rows(spark, ("x", 1))})
    other = Store(spark, store.folder)
    seen = []

    def work(v):
        if not seen:
            other.commit(v, {"a": Append(rows(spark, ("other", 1)))})
        seen.append(v.number)
        return {"a": store.read("a", v).withColumn("n", F.col("n") + 1)}

    store.change(work)
    assert seen == [1, 2] and told(store.read("a")) == [("other", 2), ("x", 2)]


def test_a_commit_that_dies_leaves_the_version_before(spark, store):
    store.commit(store.latest(), {"a": rows(spark, ("x", 1))})
    bad = rows(spark, ("x", 2)).withColumn("n", F.raise_error(F.lit("killed")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        store.commit(store.latest(), {"b": rows(spark, ("y", 1)), "a": bad})
    assert store.latest().number == 1 and told(store.read("a")) == [("x", 1)] and "b" not in store.latest().tables


def test_buckets_replace_only_their_own(spark, store):
    keys = [(f"k{i}", i) for i in range(40)]
    df = rows(spark, *keys)
    v = store.commit(store.latest(), {"t": Buckets(df, ("k",), 8, tuple(range(8)))})
    at = {r.k: r.b for r in df.select("k", bucket_of(("k",), 8).alias("b")).collect()}
    one = at["k0"]
    now = store.commit(v, {"t": Buckets(store.read("t", v, (one,)).withColumn("n", F.lit(-1).cast("long")), ("k",), 8, (one,))})
    assert told(store.read("t")) == sorted((k, -1 if at[k] == one else n) for k, n in keys)
    assert sum(now.tables["t"][b] == v.tables["t"][b] for b in v.tables["t"]) == 7
    empty = store.commit(now, {"t": Buckets(df.limit(0), ("k",), 8, (one,))})
    assert told(store.read("t", empty, (one,))) == []
    with pytest.raises(ValueError):
        store.commit(empty, {"t": Append(df.withColumn("more", F.lit(1)))})


def test_upserts(spark, store):
    store.upsert("t", rows(spark, ("a", 1), ("a", 1), ("b", 1)), "k")
    store.upsert("t", rows(spark, ("b", 2), ("c", 2)), "k")
    store.upsert("t", rows(spark, ("c", 3), ("d", 3)), "k", ignore=True)
    assert told(store.read("t")) == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]


def test_rules_alerts_and_watchlist(spark, store):
    c = commands.Commands(store)
    nodes = [("PER:ana", "ana", "PER", 3), ("LOC:ana", "ana", "LOC", 5)]
    store.commit(store.latest(), {"nodes": spark.createDataFrame(nodes, "node string, canonical string, label string, mention_count long"), "alerts": spark.createDataFrame([(1, 1, 7, "r", False), (2, 2, 8, "r", False)], commands.ALERTS)})
    assert [c.create_rule(" one ", " war "), c.create_rule("two", node="PER:ana", languages=["en"], match_in="title")] == [1, 2]
    first = store.read("rules").where("id = 1").first()
    assert (first.name, first.query, first.match_in, first.enabled) == ("one", "war", "both", True)
    at = store.latest().number
    for wrong, kind in (({"name": " "}, commands.BadRequest), ({"name": "x", "match_in": "all"}, commands.BadRequest), ({"name": "x", "node": "PER:no"}, NotFound)):
        with pytest.raises(kind):
            c.create_rule(**wrong)
    with pytest.raises(NotFound):
        c.delete_rule(9)
    with pytest.raises(NotFound):
        c.mark_read(9)
    assert store.latest().number == at
    c.mark_read(1)
    assert told(store.read("alerts").select("id", "read")) == [(1, True), (2, False)]
    c.mark_read(1, unread=True)
    assert c.mark_all_read() == 2 and c.mark_all_read() == 0
    c.delete_rule(1)
    assert told(store.read("rules").select("id")) == [(2,)] and told(store.read("alerts").select("id")) == [(2,)]
    c.watch("PER:ana", "note")
    with pytest.raises(Conflict):
        c.watch("PER:ana")
    with pytest.raises(NotFound):
        c.watch("PER:no")
    assert c.watch_named(" Ana ") == "LOC:ana"
    with pytest.raises(NotFound):
        c.watch_named("nobody")
    c.unwatch("PER:ana")
    with pytest.raises(NotFound):
        c.unwatch("PER:ana")
    assert told(store.read("watchlist")) == [("LOC:ana", None)]


def test_sources(spark, store):
    c = commands.Commands(store, lambda host: ["10.0.0.1"] if host == "inside.org" else ["93.184.216.34"])
    assert c.create_source("A", "https://a.org/") == 1 and c.create_source("B", "https://b.org/", "https://b.org/rss") == 2
    for url, rss in (("ftp://a.org", None), ("https://inside.org/", None), ("https://a.org/", None), ("https://c.org/", "http://localhost/")):
        with pytest.raises(commands.BadRequest):
            c.create_source("X", url, rss)
    c.update_source(1, name="AA", enabled=False, url=None)
    with pytest.raises(commands.BadRequest):
        c.update_source(1, url="https://b.org/")
    with pytest.raises(commands.BadRequest):
        c.update_source(1, owner="me")
    c.delete_source(2)
    for call in (lambda: c.delete_source(2), lambda: c.update_source(2, name="x"), lambda: c.update_source(5, name="x")):
        with pytest.raises(NotFound):
            call()
    assert told(store.read("sources").select("id", "name", "enabled", "deleted")) == [(1, "AA", False, False), (2, "B", False, True)]
