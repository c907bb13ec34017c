"""Stored tables in versions: data first, a list of its files next, a pointer last.

``<table>/data/commit=<id>/...`` holds data files that are never changed, ``<table>/files/<id>`` lists the files of a version, and
``<table>/versions/<number>`` names that list. A version exists once its pointer does: a writer that dies before leaves the table as it was, and
readers keep the version that they opened. Two writers that start from one version cannot both commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import few_listing_tasks
from runlens.sources.files import list_files

DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Version:
    number: int  # 0: nothing was committed yet
    listing: str | None


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, table: str, number: int | None = None) -> Version:
    """The last version, or the one asked for."""
    filesystem, folder = _path(spark, f"{table}/versions")
    if not filesystem.exists(folder):
        found: list[int] = []
    else:
        found = [int(s.getPath().getName()) for s in filesystem.listStatus(folder) if s.getPath().getName().isdigit()]
    if number is not None and number not in found:
        raise ValueError(f"{table} has no version {number}")
    if not found:
        return Version(0, None)
    chosen = max(found) if number is None else number
    _, pointer = _path(spark, f"{table}/versions/{chosen:0{DIGITS}d}")
    stream = filesystem.open(pointer)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return Version(chosen, text.strip())


def _commit(spark: SparkSession, table: str, base: Version, listing: str) -> Version:
    """The pointer, complete under another name first, moved to its place if nobody has taken it."""
    filesystem, folder = _path(spark, f"{table}/versions")
    filesystem.mkdirs(folder)
    number = base.number + 1
    _, draft = _path(spark, f"{table}/versions/_{listing}")
    _, pointer = _path(spark, f"{table}/versions/{number:0{DIGITS}d}")
    stream = filesystem.create(draft, False)
    stream.writeBytes(listing)
    stream.close()
    if filesystem.exists(pointer) or not filesystem.rename(draft, pointer):
        filesystem.delete(draft, False)
        raise Conflict(f"version {number} of {table} was committed by another writer")
    return Version(number, listing)


def files(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    """Rows (uri, length) of a version's files; none before the first commit."""
    version = version or current(spark, table)
    if version.listing is None:
        return spark.createDataFrame([], "uri string, length bigint")
    return spark.read.parquet(f"{table}/files/{version.listing}")


def _stage(df: DataFrame, table: str, write: Callable[[DataFrameWriter], DataFrameWriter] | None) -> tuple[str, DataFrame]:
    """Write the data of a commit; its name, and its files."""
    name = uuid.uuid4().hex
    writer = df.write if write is None else write(df.write)
    writer.parquet(f"{table}/data/commit={name}")
    return name, list_files(df.sparkSession, f"{table}/data/commit={name}", "*.parquet")


def replace(df: DataFrame, table: str, write: Callable[[DataFrameWriter], DataFrameWriter] | None = None) -> Version:
    """Commit ``df`` as the table's next version; ``write`` sets partitions and options of the writer. ``df`` may read the table itself."""
    spark = df.sparkSession
    base = current(spark, table)
    name, own = _stage(df, table, write)
    own.write.parquet(f"{table}/files/{name}")
    return _commit(spark, table, base, name)


def append(df: DataFrame, table: str, write: Callable[[DataFrameWriter], DataFrameWriter] | None = None) -> Version:
    """Commit the files of the last version and those of ``df``."""
    spark = df.sparkSession
    base = current(spark, table)
    name, own = _stage(df, table, write)
    files(spark, table, base).unionByName(own).write.parquet(f"{table}/files/{name}")
    return _commit(spark, table, base, name)


def _opened(spark: SparkSession, table: str, chosen: DataFrame, schema: T.StructType | None) -> DataFrame:
    """The rows of some files. Their paths pass the driver, where Spark keeps the listing of every table it reads."""
    decoded = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    paths = [r.path for r in chosen.select(decoded.alias("path")).orderBy("path").collect()]
    if not paths:
        if schema is None:
            raise ValueError(f"{table} has no files, so its columns are unknown")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema.add("commit", "string") if "commit" not in schema.names else schema)
    with few_listing_tasks(spark):
        return reader.option("basePath", f"{table}/data").parquet(*paths).drop("commit")


def read(spark: SparkSession, table: str, schema: T.StructType | None = None, number: int | None = None) -> DataFrame:
    """The table as it is now, or in an earlier version; later commits do not change what this frame reads."""
    pinned = None if schema is None else T.StructType(list(schema.fields))
    return _opened(spark, table, files(spark, table, current(spark, table, number)), pinned)


def rewrite(
    spark: SparkSession, table: str, chosen: DataFrame, change: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrameWriter], DataFrameWriter] | None = None, schema: T.StructType | None = None,
) -> Version:
    """Copy on write: only the files in ``chosen`` (uri) are read, changed and written; the others stay in the next version as they are.

    Without chosen files the table stays at its version.
    """
    base = current(spark, table)
    before = files(spark, table, base)
    hit = before.join(chosen.select("uri").distinct(), "uri", "left_semi")
    if hit.isEmpty():
        return base
    pinned = None if schema is None else T.StructType(list(schema.fields))
    name, own = _stage(change(_opened(spark, table, hit, pinned)), table, write)
    before.join(hit.select("uri"), "uri", "left_anti").unionByName(own).write.parquet(f"{table}/files/{name}")
    return _commit(spark, table, base, name)


def cast_columns(types: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """A change that gives columns their one type; absent ones are passed over."""
    def change(df: DataFrame) -> DataFrame:
        cast: dict[str, Column] = {c: F.col(f"`{c}`").cast(t) for c, t in types.items() if c in df.columns}
        return df.withColumns(cast) if cast else df

    return change


def forget(spark: SparkSession, table: str, keep: int = 1) -> int:
    """Delete the versions before the last ``keep``, and the commits that no kept version lists; how many commits went.

    A reader of a deleted version fails; so does a writer that has staged its data but not committed yet, so run it when none is at work.
    """
    last = current(spark, table)
    kept = [current(spark, table, n) for n in range(max(1, last.number - keep + 1), last.number + 1)]
    filesystem, data = _path(spark, f"{table}/data")
    used: set[str] = set()
    for version in kept:
        commits = files(spark, table, version).select(F.regexp_extract("uri", r"/commit=([0-9a-f]+)/", 1).alias("commit")).distinct()
        used |= {r["commit"] for r in commits.collect()}  # one per commit, not per file
    gone = 0
    for status in filesystem.listStatus(data) if filesystem.exists(data) else []:
        if status.getPath().getName().removeprefix("commit=") not in used:
            gone += filesystem.delete(status.getPath(), True)
    for number in range(1, last.number - keep + 1):
        _, pointer = _path(spark, f"{table}/versions/{number:0{DIGITS}d}")
        filesystem.delete(pointer, False)
    listings = {v.listing for v in kept}
    _, lists = _path(spark, f"{table}/files")
    for status in filesystem.listStatus(lists) if filesystem.exists(lists) else []:
        if status.getPath().getName() not in listings:
            filesystem.delete(status.getPath(), True)
    return gone


def partitioned(*columns: str, **options: str | int) -> Callable[[DataFrameWriter], DataFrameWriter]:
    """Writer settings of a partitioned table."""
    return lambda writer: writer.partitionBy(*columns).options(**{k.replace("__", "."): v for k, v in options.items()})


def conflicting(footers: DataFrame, columns: Sequence[str], expected: str = "double") -> DataFrame:
    """Files (uri) in which one of the columns has another type than expected; see ``files.footer_columns``."""
    return footers.where(F.col("column").isin(*columns) & (F.col("type") != expected)).select("uri").distinct()
