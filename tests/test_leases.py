"""Leases: transitions, a lease that runs out without an event, and replays."""

from datetime import datetime, timedelta

import pytest

from brindle.streaming import leases

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    kept = {k: spark.conf.get(k, None) for k in leases.STORE}
    for k, v in leases.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_transitions():
    f = leases.after
    assert f(None, None, 0, "found", None) == ("new", None, 0) and f("new", None, 0, "found", None) is None
    assert f("new", None, 0, "claimed", "extract") == ("new", "extract", 0)
    assert f("new", "extract", 0, "claimed", "extract") is None and f("new", None, 0, "claimed", "ner") is None and f("new", None, 3, "claimed", "extract") is None
    assert f("new", "extract", 2, "done", "extract") == ("extracted", None, 0) and f("new", None, 0, "done", "extract") is None
    assert f("fetched", "extract", 0, "failed", "extract") == ("new", None, 1) and f("new", "extract", 2, "failed", "extract") == ("failed", None, 3)
    assert f("extracted", "analyze", 0, "done", "extract") is None and f("new", None, 0, "odd", "extract") is None


def run(spark, tmp_path, name):
    """The states of three files of events, in the order of article and time."""
    minute = lambda m: T0 + timedelta(minutes=m)
    files = [
        [(1, "found", None, minute(0)), (1, "claimed", "extract", minute(1)), (2, "found", None, minute(0)), (2, "claimed", "extract", minute(1)), (5, "found", None, minute(0)), (5, "claimed", "extract", minute(1)), (None, "found", None, minute(0))],
        [(2, "done", "extract", minute(3)), (2, "claimed", "analyze", minute(4)), (2, "failed", "analyze", minute(5)), (3, "found", None, minute(20))],
        [(1, "done", "extract", minute(21)), (1, "claimed", "extract", minute(22)), (1, "done", "extract", minute(23)), (3, "found", None, minute(40))],
        [(4, "found", None, minute(60))],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, leases.EVENTS).coalesce(1).write.parquet(str(tmp_path / name / f"f{i}"))
    stream = spark.readStream.schema(leases.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    out = leases.lease_states(stream)
    query = out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(((r.id, (r.at - T0).total_seconds() / 60, r.event, r.status, r.retry_count) for r in spark.table(name).collect()), key=lambda r: (r[0], r[1]))


def test_a_lease_that_runs_out_returns_the_article(rocks, tmp_path):
    first = run(rocks, tmp_path, "leases_a")
    assert first == [
        (1, 0, "found", "new", 0), (1, 1, "claimed", "new", 0), (1, 6, "lease over", "new", 0), (1, 21, "done refused", "new", 0), (1, 22, "claimed", "new", 0), (1, 23, "done", "extracted", 0),
        (2, 0, "found", "new", 0), (2, 1, "claimed", "new", 0), (2, 3, "done", "extracted", 0), (2, 4, "claimed", "extracted", 0), (2, 5, "failed", "extracted", 1),
        (3, 20, "found", "new", 0), (3, 40, "found refused", "new", 0), (4, 60, "found", "new", 0),
        (5, 0, "found", "new", 0), (5, 1, "claimed", "new", 0), (5, 6, "lease over", "new", 0),  # no event tells this
    ]
    assert run(rocks, tmp_path, "leases_b") == first
