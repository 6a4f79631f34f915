"""Feeds through the data source: the guard, a partition a source, and streams that go on where they stopped."""

import json

import pytest

from brindle.sources import discovery, feeds

PLUGS = {"get": "tests.plugged_network:get", "resolve": "tests.plugged_network:resolve"}


def test_a_batch_of_sources(spark):
    sources = [{"id": 1, "url": "https://a.org/feed"}, {"id": 2, "url": "https://a.org/moved"}, {"id": 3, "url": "https://b.org/gone"}, {"id": 4, "url": "http://localhost/x"}]
    df = discovery.discovered(spark, sources, **PLUGS)
    assert df.rdd.getNumPartitions() == 4
    rows = {r.source_id: r for r in df.collect()}
    assert rows[1].status == 200 and rows[1].error is None
    assert rows[2].error.startswith("Refused") and rows[2].body is None and rows[3].error == "status 404" and rows[4].error.startswith("Refused")
    assert [(r.source_id, r.url, r.title) for r in feeds.rss_entries(df).collect()] == [(1, "https://a.org/feed/news/1", "T1"), (1, "https://a.org/feed/news/0", "T0")]
    assert discovery.discovered(spark, [], **PLUGS).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    state = tmp_path / "captures.json"
    sources = [{"id": i, "url": f"https://{h}.org/feed", "capture": f"https://{h}.org/feed/{{n}}", "counts": str(state)} for i, h in ((1, "a"), (2, "b"))]
    seen = []

    def run(counts):
        state.write_text(json.dumps(counts))
        stream = discovery.discovered(spark, sources, stream=True, latest="tests.plugged_network:latest", **PLUGS)
        before = len(seen)
        query = stream.select("source_id", "capture", "error").writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()
        return sorted(seen[before:])

    assert run({"1": 2, "2": 1}) == [(1, 1, None), (1, 2, None), (2, 1, None)]
    assert run({"1": 2, "2": 3}) == [(2, 2, None), (2, 3, None)]
    assert run({"1": 2, "2": 3}) == []


def test_offsets_and_options():
    reader = discovery.FeedStream({"sources": json.dumps([{"id": 1, "url": "u", "capture": "u/{n}"}, {"id": 2, "url": "v", "capture": "v/{n}"}])})
    assert reader.initialOffset() == {"1": 0, "2": 0}
    assert [(p.source["id"], p.first, p.last) for p in reader.partitions({"1": 3}, {"1": 5, "2": 1})] == [(1, 4, 5), (2, 1, 1)]
    for wrong in ({"sources": '[{"id": 1}]'}, {"sources": '[{"url": "u"}]'}):
        with pytest.raises(ValueError):
            discovery.FeedReader(wrong)
    with pytest.raises(ValueError):
        discovery.plugged("nothing")
