"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []  # what scratch_path has handed out


def build_session(app: str = "runlens", master: str | None = None) -> SparkSession:
    """A session with the settings the library relies on; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_listing_tasks(spark: SparkSession):
    """For the call that opens files for reading: their folders are listed by two tasks per core. Spark makes a task of every folder, which costs more than the listing."""
    return _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(2 * spark.sparkContext.defaultParallelism))


def sorted_aggregates(spark: SparkSession):
    """For an action that aggregates into large sketches: groups come in order, so a task holds those of one group, not of up to 128."""
    return _setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder; a cluster session is refused, because executors
    could not see each other's files there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the steps that this process has stored so far, and say how many there were.

    Frames are lazy, so only their user knows when the last one that reads a step is done; those that still do fail afterwards.
    """
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step once and read it back: later steps use it several times, read only the columns they need, and Spark knows its size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
