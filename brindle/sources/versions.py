"""Sinks whose tables change together: versions under a manifest.

A folder holds Parquet parts that are never overwritten, and a manifest for each version that lists the
parts of every table. A commit writes new parts, then the next manifest under a name that may not exist yet:
whoever comes second finds it there and gets a Conflict, and a reader keeps to one manifest and so sees one version. A
commit that dies leaves parts that no manifest lists. A table may be cut into buckets by a hash of its key, of which a commit
replaces only some. Manifests are a few names for each table and bucket; rows never pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class NotFound(LookupError):
    """No such table, version or row."""


class Conflict(ValueError):
    """Somebody else committed first, or the row is there already."""


class Behind(Conflict):
    """Somebody else committed the version first."""


@dataclass(frozen=True)
class Append:
    """Rows that are added to a table."""

    rows: DataFrame


@dataclass(frozen=True)
class Buckets:
    """Rows in place of some buckets of a table, by a hash of ``keys``; buckets that aren't named stay."""

    rows: DataFrame
    keys: tuple[str, ...]
    count: int
    replaced: tuple[int, ...]


@dataclass(frozen=True)
class Version:
    """What a manifest says: the parts of each table by bucket ("" without buckets), and notes."""

    number: int = 0
    tables: Mapping[str, Mapping[str, list[str]]] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    notes: Mapping[str, object] = field(default_factory=dict)


def bucket_of(keys: tuple[str, ...], count: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


class Store:
    """Versions of some tables in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _manifest(self, number: int) -> str:
        return f"manifests/{number:012d}.json"

    def latest(self) -> Version:
        """The newest version; number 0 without tables in a fresh folder."""
        try:
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        except Exception as e:  # the folder isn't there yet
            if "FileNotFound" not in str(e):
                raise
            found = []
        numbers = [int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[:-5].isdigit()]
        return self.version(max(numbers)) if numbers else Version()

    def version(self, number: int) -> Version:
        if not self._fs.exists(self._path(self._manifest(number))):
            raise NotFound(f"no version {number}")
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{self._manifest(number)}", wholetext=True).collect())
        return Version(**json.loads(text))

    def _publish(self, version: Version) -> None:
        """Makes a manifest visible at once, unless there is one of that number."""
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        # a rename of FileContext fails where the name is taken, unlike that of some file systems
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(self._manifest(version.number)), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Behind(f"version {version.number} is there already") from None
            raise

    # tables

    def read(self, table: str, version: Version | None = None, buckets: tuple[int, ...] | None = None) -> DataFrame:
        """A table, or some of its buckets, as one version has it."""
        v = version or self.latest()
        if table not in v.tables:
            raise NotFound(f"no table {table}")
        parts = v.tables[table]
        wanted = [p for b, ps in parts.items() if buckets is None or b == "" or int(b) in buckets for p in ps]
        if not wanted:
            return self.spark.createDataFrame([], v.schemas[table])
        return self.spark.read.schema(v.schemas[table]).parquet(*[f"{self.folder}/{p}" for p in wanted])

    def _part(self, table: str, rows: DataFrame) -> str:
        part = f"tables/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def commit(self, base: Version, changes: Mapping[str, DataFrame | Append | Buckets], **notes: object) -> Version:
        """The version after ``base``: tables replaced by DataFrames, added to, or with some buckets replaced. Conflict if there is one already."""
        tables = {t: dict(p) for t, p in base.tables.items()}
        schemas = dict(base.schemas)
        for name, change in changes.items():
            rows = change if isinstance(change, DataFrame) else change.rows
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            if isinstance(change, DataFrame) or name not in tables:
                schemas[name] = schema
            elif schemas[name] != schema:
                raise ValueError(f"{name} has columns {schemas[name]}, not {schema}")
            if isinstance(change, Buckets):
                if set(tables.get(name, {})) == {""}:
                    raise ValueError(f"{name} isn't cut into buckets")
                # one write for all buckets, each in a folder of its own
                part = f"tables/{name}/{uuid.uuid4().hex}"
                at = bucket_of(change.keys, change.count)
                rows.where(at.isin(*change.replaced)).withColumn("__bucket", at).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{part}")
                own = tables.setdefault(name, {})
                for b in change.replaced:
                    folder = f"{part}/__bucket={b}"
                    own[str(b)] = [folder] if self._fs.exists(self._path(folder)) else []
            elif isinstance(change, Append):
                tables.setdefault(name, {}).setdefault("", []).append(self._part(name, rows))
            else:
                tables[name] = {"": [self._part(name, rows)]}
        new = Version(base.number + 1, tables, schemas, {**base.notes, **notes})
        self._publish(new)
        return new

    def change(self, work: Callable[[Version], Mapping[str, DataFrame | Append | Buckets]], tries: int = 5, **notes: object) -> Version:
        """Commits what ``work`` makes of the newest version, anew if somebody else was first; Conflict after so many tries."""
        for left in range(tries - 1, -1, -1):
            base = self.latest()
            try:
                return self.commit(base, work(base), **notes)
            except Behind:
                if not left:
                    raise
        raise AssertionError

    def upsert(self, table: str, rows: DataFrame, *keys: str, ignore: bool = False) -> Version:
        """Rows by their keys: in place of those that are there, or, to ignore, only those that aren't. Of rows that share their keys one counts."""
        once = rows.dropDuplicates(list(keys))

        def work(v: Version) -> Mapping[str, DataFrame | Append]:
            if table not in v.tables:
                return {table: once}
            old = self.read(table, v)
            if ignore:
                return {table: Append(once.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))}
            return {table: old.join(once.select(*keys), list(keys), "left_anti").unionByName(once.select(*old.columns))}

        return self.change(work)
