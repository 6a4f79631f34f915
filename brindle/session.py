"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "brindle", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE with skew joins, no UI."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``, else what setCheckpointDir was
    given. Only on one machine (a local master) a temporary folder takes its place, which goes when Python ends; elsewhere
    a missing folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN:  # a core setting can't change in a running session, so it is kept here
        _OWN[app] = tempfile.mkdtemp(prefix="brindle-shared-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


_OWN: dict[str, str] = {}


def table_path(spark: SparkSession, kind: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint: later reads survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def next_round(df: DataFrame) -> DataFrame:
    """A written table in place of a checkpoint, for loops.

    A checkpoint keeps the size that its plan was estimated to have, and joins multiply such estimates: after some rounds they
    are numbers of thousands of digits, and planning takes longer than the work. The size of a written table is that of its files.
    """
    path = table_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
