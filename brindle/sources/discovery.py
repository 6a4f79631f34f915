"""Feeds as a data source of Spark, in batches and as a stream.

spark.read.format("feeds") gives a row (source_id, source_url, status, body, error) for each source, which
feeds.rss_entries() and its kin take on. Every source is a partition of its own, so that sources are read
side by side and a failing one is a row with an error. The network is plugged in, and the guard of addresses, redirects and sizes stands in front of it.

Options: ``sources``, a JSON list of {"id", "url"}; ``get`` and ``resolve``, each "module:function", as
feeds.guarded_fetch() takes them. A stream needs captures that have numbers: ``latest``, "module:function", tells
how many a source has, and "capture" in a source is the url of one, with {n} for its number from 1. The offset of
a stream is the number read of each source, so a restart goes on after the last committed one, and the same offsets give the same rows again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from brindle.sources.feeds import decoded_body, guarded_fetch

SCHEMA = "source_id long, source_url string, capture long, status int, body string, error string"


def plugged(name: str | None) -> Callable:
    """The function that "module:function" names."""
    module, _, function = (name or "").partition(":")
    if not module or not function:
        raise ValueError(f"name a function as module:function, not {name!r}")
    return getattr(import_module(module), function)


@dataclass
class Captures(InputPartition):
    """Captures first..last of a source; 0 stands for the source's url itself."""

    source: dict
    first: int
    last: int


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.sources = json.loads(self.options.get("sources", "[]"))
        for s in self.sources:
            if not isinstance(s.get("id"), int) or not s.get("url"):
                raise ValueError(f"a source needs an id and a url: {s}")

    def read(self, partition: Captures | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        get, resolve = plugged(self.options.get("get")), plugged(self.options.get("resolve"))
        for n in range(partition.first, partition.last + 1):
            s = partition.source
            url = s["capture"].replace("{n}", str(n)) if n else s["url"]
            try:
                status, headers, body = guarded_fetch(url, get, resolve)
                text = decoded_body(status, headers, body)
                yield s["id"], s["url"], n, status, text, None if text is not None else f"status {status}"
            except Exception as e:  # one source's failure is its own row
                yield s["id"], s["url"], n, None, None, f"{type(e).__name__}: {e}"[:500]


class FeedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Captures]:
        return [Captures(s, 0, 0) for s in self.sources]


class FeedStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {str(s["id"]): 0 for s in self.sources}

    def latestOffset(self) -> dict:
        latest = plugged(self.options.get("latest"))
        return {str(s["id"]): latest(s) for s in self.sources}

    def partitions(self, start: dict, end: dict) -> list[Captures]:
        """A source that is new since the last run begins with its first capture."""
        spans = [(s, start.get(str(s["id"]), 0) + 1, end.get(str(s["id"]), 0)) for s in self.sources]
        return [Captures(s, a, b) for s, a, b in spans if a <= b]

    def commit(self, end: dict) -> None:
        pass


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def discovered(spark: SparkSession, sources: list[dict], stream: bool = False, **plugs: str) -> DataFrame:
    """The feeds of some sources, as a batch or as a stream of their captures."""
    spark.dataSource.register(Feeds)
    reader = (spark.readStream if stream else spark.read).format("feeds").option("sources", json.dumps(sources))
    for name, function in plugs.items():
        reader = reader.option(name, function)
    return reader.load()
