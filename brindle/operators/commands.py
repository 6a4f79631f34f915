"""Changes to small tables: read, transform, write a new version. Wrong requests raise."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.feeds import url_allowed
from brindle.sources.versions import Append, Conflict, NotFound, Store, Version

__all__ = ["BadRequest", "Commands", "Conflict", "NotFound", "active_sources", "add", "delete_source", "mark_read", "patch", "remove", "restore_source"]

RULES = "id long, name string, query string, languages array<string>, min_sentiment double, node string, match_in string, enabled boolean"
ALERTS = "id long, rule_id long, article_id long, reason string, read boolean"
WATCHLIST = "node string, note string"
SOURCES = "id long, name string, url string, rss_url string, enabled boolean, deleted boolean"


class BadRequest(ValueError):
    """The request itself is wrong."""


def _needs(df: DataFrame, key: str, value) -> None:
    if df.where(F.col(key) == value).isEmpty():
        raise NotFound(f"no {key} {value}")


def add(df: DataFrame, row: dict, unique: str) -> DataFrame:
    if not df.where(F.col(unique) == row[unique]).isEmpty():
        raise Conflict(f"{unique} {row[unique]} is there already")
    return df.unionByName(df.sparkSession.createDataFrame([row], df.schema))


def remove(df: DataFrame, key: str, value) -> DataFrame:
    _needs(df, key, value)
    return df.where(F.col(key) != value)


def patch(df: DataFrame, key: str, value, changes: dict) -> DataFrame:
    _needs(df, key, value)
    return df.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in changes.items()})


def mark_read(alerts: DataFrame, alert_id: int | None = None, read: bool = True) -> DataFrame:
    """One alert, or all."""
    return alerts.withColumn("read", F.lit(read)) if alert_id is None else patch(alerts, "id", alert_id, {"read": read})


def delete_source(sources: DataFrame, source_id: int) -> DataFrame:
    """A soft delete: the row stays, disabled."""
    return patch(sources.where("not deleted"), "id", source_id, {"deleted": True, "enabled": False}).unionByName(sources.where("deleted"))


def restore_source(sources: DataFrame, source_id: int) -> DataFrame:
    return patch(sources, "id", source_id, {"deleted": False, "enabled": True})


def active_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    out = sources.where("not deleted")
    return out.where("enabled") if enabled_only else out


class Commands:
    """The commands over a store of versions: each is one commit, made anew if another one came first.

    BadRequest, NotFound and Conflict say what is wrong with a request; nothing is written then. New ids follow the greatest one.
    ``resolve`` looks up the addresses of a host for the guard of source urls.
    """

    def __init__(self, store: Store, resolve: Callable[[str], list[str]] | None = None) -> None:
        self.store, self.resolve = store, resolve
        schemas = {"rules": RULES, "alerts": ALERTS, "watchlist": WATCHLIST, "sources": SOURCES}
        store.change(lambda v: {t: store.spark.createDataFrame([], s) for t, s in schemas.items() if t not in v.tables})

    def _table(self, name: str, v: Version) -> DataFrame:
        return self.store.read(name, v)

    def _change(self, name: str, work: Callable[[DataFrame, Version], DataFrame | Append]) -> Version:
        return self.store.change(lambda v: {name: work(self._table(name, v), v)})

    def _appended(self, name: str, row: Mapping[str, object], check: Callable[[DataFrame, Version], None]) -> int:
        """Adds a row under the next id."""
        made: list[int] = []

        def work(old: DataFrame, v: Version) -> Append:
            check(old, v)
            made.append((old.agg(F.max("id")).first()[0] or 0) + 1)
            return Append(self.store.spark.createDataFrame([{**row, "id": made[-1]}], old.schema))

        self._change(name, work)
        return made[-1]

    def _node_is_there(self, v: Version, node: str) -> None:
        if "nodes" not in v.tables or self._table("nodes", v).where(F.col("node") == node).isEmpty():
            raise NotFound("entity node not found")

    def create_rule(self, name: str, query: str | None = None, languages: list[str] | None = None, min_sentiment: float | None = None, node: str | None = None, match_in: str = "both", enabled: bool = True) -> int:
        if not name.strip():
            raise BadRequest("name is required")

        def check(_: DataFrame, v: Version) -> None:
            if node is not None:
                self._node_is_there(v, node)
            if match_in not in ("title", "content", "both"):
                raise BadRequest("match_in must be title, content or both")

        row = {"name": name.strip(), "query": query.strip() if query else None, "languages": languages, "min_sentiment": min_sentiment, "node": node, "match_in": match_in, "enabled": enabled}
        return self._appended("rules", row, check)

    def delete_rule(self, rule_id: int) -> None:
        """A rule and its alerts."""
        self.store.change(lambda v: {"rules": remove(self._table("rules", v), "id", rule_id), "alerts": self._table("alerts", v).where(F.col("rule_id") != rule_id)})

    def mark_read(self, alert_id: int, unread: bool = False) -> None:
        self._change("alerts", lambda old, _: mark_read(old, alert_id, not unread))

    def mark_all_read(self) -> int:
        """How many were unread."""
        counted: list[int] = []

        def work(old: DataFrame, _: Version) -> DataFrame:
            counted.append(old.where("not read").count())
            return mark_read(old)

        self._change("alerts", work)
        return counted[-1]

    def watch(self, node: str, note: str | None = None) -> None:
        def work(old: DataFrame, v: Version) -> Append:
            self._node_is_there(v, node)
            if not old.where(F.col("node") == node).isEmpty():
                raise Conflict("entity already in watchlist")
            return Append(self.store.spark.createDataFrame([(node, note)], old.schema))

        self._change("watchlist", work)

    def watch_named(self, name: str, label: str | None = None, note: str | None = None) -> str:
        """Watches the most mentioned node of a canonical name; which one that is."""
        v = self.store.latest()
        found = self._table("nodes", v).where(F.col("canonical") == name.strip().lower()) if "nodes" in v.tables else None
        best = None if found is None else (found.where(F.col("label") == label) if label else found).orderBy(F.desc("mention_count"), "node").select("node").first()
        if best is None:
            raise NotFound("entity node not found")
        self.watch(best[0], note)
        return best[0]

    def unwatch(self, node: str) -> None:
        self._change("watchlist", lambda old, _: remove(old, "node", node))

    def _url(self, url: str | None, needed: bool = True) -> None:
        if (url or needed) and not (url_allowed(url, self.resolve) if self.resolve else url_allowed(url or "")):
            raise BadRequest("URL must be http(s) and publicly reachable")

    def create_source(self, name: str, url: str, rss_url: str | None = None, enabled: bool = True) -> int:
        self._url(url)
        self._url(rss_url, False)

        def check(old: DataFrame, _: Version) -> None:
            if not old.where(F.col("url") == url).isEmpty():
                raise BadRequest("a source with this URL already exists")

        return self._appended("sources", {"name": name, "url": url, "rss_url": rss_url, "enabled": enabled, "deleted": False}, check)

    def update_source(self, source_id: int, **changes: object) -> None:
        """Changes of name, url, rss_url and enabled; None leaves a value as it is."""
        wanted = {c: x for c, x in changes.items() if x is not None}
        if unknown := set(changes) - {"name", "url", "rss_url", "enabled"}:
            raise BadRequest(f"no such fields: {sorted(unknown)}")

        def work(old: DataFrame, _: Version) -> DataFrame:
            _needs(old.where("not deleted"), "id", source_id)
            if "url" in wanted:
                self._url(wanted["url"])
                if not old.where((F.col("url") == wanted["url"]) & (F.col("id") != source_id)).isEmpty():
                    raise BadRequest("a source with this URL already exists")
            self._url(wanted.get("rss_url"), False)
            return patch(old, "id", source_id, wanted)

        self._change("sources", work)

    def delete_source(self, source_id: int) -> None:
        self._change("sources", lambda old, _: delete_source(old, source_id))
