"""File listings, paths, headers and footers. Contents are opened on executors only."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.names import group_name, group_tag, measurement_ts
from runlens.session import scratch_path

HEADER_CHUNK = 1 << 16
HEADER_LIMIT = 1 << 24
DEEPEST = 64  # levels of folders
LISTED_ROWS = 10_000  # names of a batch
LEGAL = "/-_.!~*'(),;:$&+=@"  # what Spark leaves as it is in the path of a URI, besides letters, digits and all beyond ASCII


def file_uri() -> Column:
    """The file of a row, in one form: Spark writes local paths with one slash or with three."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def n_tasks(spark: SparkSession) -> int:
    """Tasks for work that goes by files: two per core. A file costs the same however short its row is, so Spark's sizes by bytes do not fit."""
    return 2 * spark.sparkContext.defaultParallelism


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Rows (uri, length) of all files below ``root`` whose name fits the pattern; ``*`` stands for any text. Tasks list, nothing is read."""
    name = re.escape(encoded(pattern)).replace(r"\*", "[^/]*")
    return walk(spark, root).where(F.col("uri").rlike(f"/{name}$") & ~F.col("uri").endswith("/"))


def encoded(path: str) -> str:
    """A path as Spark writes it in ``_metadata.file_path``."""
    return "".join(c if ord(c) > 127 else quote(c, safe=LEGAL) for c in path)


def root_uri(spark: SparkSession, root: str) -> str:
    """The URI of a folder in the form of ``file_uri``, ending in a slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return re.sub("^file:/+", "file:/", whole.toUri().toString()).rstrip("/") + "/"


def _entries(uri: str) -> list[tuple[str, bool, int]]:
    """What lies right in a folder: names that Spark reads, folders or not, and lengths. A folder that is gone is empty."""
    filesystem, path = located(uri)
    chosen = pyarrow.fs.FileSelector(path, allow_not_found=True)
    return [
        (e.base_name, e.type == pyarrow.fs.FileType.Directory, max(e.size or 0, 0))
        for e in filesystem.get_file_info(chosen)
        if not e.base_name.startswith(".") and (not e.base_name.startswith("_") or "=" in e.base_name)
    ]


def walk(spark: SparkSession, root: str, descend: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (uri, length) of all files and all folders below ``root``; a folder's URI ends in a slash, and its length is 0.

    The folders of a level are rows, dealt out to tasks that list them; what they hold is stored, and its folders are the next
    level. So empty folders are rows too, a level is listed by the whole cluster, and the driver learns only whether there is
    another level. ``descend`` says of a folder's URI whether it is gone into. Names that Spark does not read are left out.
    A root that is missing or empty gives no rows.
    """

    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, int]] = []

        def listed() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["uri", "length"]).astype({"uri": str, "length": "int64"})

        for batch in batches:
            for uri in batch["uri"]:
                rows += [(uri + encoded(name) + "/" * folder, 0 if folder else size) for name, folder, size in _entries(uri)]
                if len(rows) >= LISTED_ROWS:
                    yield listed()
                    rows = []
        yield listed()

    folders, levels = spark.createDataFrame([(root_uri(spark, root),)], "uri string"), []
    for _ in range(DEEPEST):
        path = scratch_path(spark, "level")
        dealt = folders.repartition(n_tasks(spark), "uri") if levels else folders
        dealt.mapInPandas(list_folders, "uri string, length bigint").write.parquet(path)
        levels.append(spark.read.parquet(path))
        inner = F.col("uri").endswith("/")
        folders = levels[-1].where(inner & descend(F.col("uri")) if descend else inner).select("uri")
        if folders.isEmpty():
            return reduce(DataFrame.union, levels)
    raise ValueError(f"folders lie more than {DEEPEST} levels deep")


def within_runs(uri: Column) -> Column:
    """Folders that can lead to a run's data: inside a run only its data folder is gone into."""
    below = F.regexp_extract(uri, r"/(?:session=)?Session_[^/]+/[^/]+/(.+)$", 1)
    return (below == "") | below.rlike(r"^(?:traffic_generator|file=[^/]+)/$")


def path_parts(uri: Column) -> dict[str, Column]:
    """Tranche, session, run and file stem of a raw path.

    Both layouts are read: ``Tranche_X/Session_N/run/traffic_generator/stem.csv`` and the
    partitioned one, ``tranche=Tranche_X/session=Session_N/run_id=run/file=stem/part.csv``.
    """
    text = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    return {
        "tranche": part(r"/(?:tranche=)?(Tranche_[^/]+)/"),
        "session": part(r"/(?:session=)?(Session_[^/]+)/"),
        "run_id": part(r"/(?:session=)?Session_[^/]+/(?:run_id=)?([^/]+)/"),
        "stem": F.coalesce(part(r"/file=([^/]+)/[^/]+$"), part(r"/([^/]+)\.[^./]+$")),
    }


def run_tree(files: DataFrame) -> DataFrame:
    """Files of run folders, and these folders and those in them where ``files`` comes from ``walk``: below a tranche and a
    session, with a name that starts with cipher.

    ``is_csv`` holds for the files that are read: CSVs right in a run's data folder, or parts of a ``file=`` folder.
    """
    in_data = F.col("uri").rlike(r"/(?:traffic_generator|file=[^/]+)/[^/]+\.csv$")
    parsed = files.withColumns(path_parts(F.col("uri")))
    known = F.col("tranche").isNotNull() & F.lower("run_id").startswith("cipher")
    return parsed.where(known).withColumns({
        "grp": group_name(F.col("stem")),
        "tag": group_tag(group_name(F.col("stem"))),
        "measurement_ts": measurement_ts(F.col("stem")),
        "is_csv": in_data,
    })


def run_sizes(tree: DataFrame) -> DataFrame:
    """Runs with their CSV files and bytes, whether or not a file is selected later.

    A run without any file is there if ``tree`` comes from ``walk``; a file listing of Spark does not see it.
    """
    return tree.groupBy("tranche", "session", "run_id").agg(
        F.count_if("is_csv").alias("n_csv"),
        F.sum(F.when(F.col("is_csv"), F.col("length")).otherwise(0)).alias("raw_size_bytes"),
        F.max(F.col("uri").contains("/traffic_generator/") | F.col("uri").contains("/file=")).alias("has_data"),
        F.min(F.when(F.col("is_csv"), F.col("measurement_ts"))).alias("measurement_ts"),
    )


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path there, without a slash at its end."""
    parts = urlsplit(uri)
    path = quote(parts.path.rstrip("/") or "/", safe=LEGAL + "%")  # Arrow takes ASCII only
    return pyarrow.fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{path}")


def _open(uri: str):
    filesystem, path = located(uri)
    return filesystem.open_input_file(path)


def _header(uri: str) -> list[str]:
    """The first record; a huge file without a line break is given up after ``HEADER_LIMIT`` bytes."""
    data = b""
    with _open(uri) as stream:
        while len(data) <= HEADER_LIMIT:
            chunk = stream.read(HEADER_CHUNK)
            data += chunk
            lines = data.decode("utf-8-sig", "replace").splitlines(keepends=True)
            text = "".join(lines if not chunk else lines[:-1])
            if text and (not chunk or text.count('"') % 2 == 0):
                return next(csv.reader(io.StringIO(text)), [])
            if not chunk:
                return []
    raise ValueError("no header within the first bytes")


def csv_headers(files: DataFrame) -> DataFrame:
    """Rows (uri, names, error): each task opens the start of its files."""

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri in batch["uri"]:
                try:
                    names = _header(uri)
                    rows.append((uri, names, None if names else "empty file"))
                except Exception as error:
                    rows.append((uri, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["uri", "names", "error"])

    dealt = files.select("uri").repartition(n_tasks(files.sparkSession), "uri")
    return dealt.mapInPandas(peek, "uri string, names array<string>, error string")


def footer_columns(files: DataFrame) -> DataFrame:
    """Rows (uri, column, type, error) from Parquet footers; no data page is read."""

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for uri in batch["uri"]:
                try:
                    with _open(uri) as stream:
                        schema = pyarrow.parquet.read_schema(stream)
                    rows += [(uri, f.name, str(f.type), None) for f in schema]
                except Exception as error:
                    rows.append((uri, None, None, f"{type(error).__name__}: {error}"))
                if len(rows) >= LISTED_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    names = ["uri", "column", "type", "error"]
    schema = "uri string, column string, type string, error string"
    found = files.select("uri").repartition(n_tasks(files.sparkSession), "uri").mapInPandas(peek, schema)
    return found.withColumns({
        "path": F.col("uri"),
        "tranche": path_parts(F.col("uri"))["tranche"],
    })


def footer_statistics(files: DataFrame) -> DataFrame:
    """Rows (uri, row_group, column, type, n_rows, n_nulls, least, most, known, error): what the footers say of number columns.

    ``known`` says that the footer tells all: how many values are null, and the least and most of the others. It is false where the writer
    left statistics out, where one of them is NaN, and for floating-point columns of writers that pass over NaN. A file that
    does not open is one row with its error. No data page is read.
    """

    def facts(uri: str) -> Iterator[tuple]:
        with _open(uri) as stream:
            found = pyarrow.parquet.ParquetFile(stream)
            telling = found.metadata.created_by.startswith("parquet-mr")  # leaves the ends out where a NaN is among the values
            types = {f.name: str(f.type) for f in found.schema_arrow}
            for g in range(found.metadata.num_row_groups):
                group = found.metadata.row_group(g)
                for c in range(group.num_columns):
                    column = group.column(c)
                    kind = types.get(column.path_in_schema, "")
                    floating = kind in ("float", "double")
                    if not floating and not kind.startswith(("int", "uint")):
                        continue
                    seen = column.statistics
                    nulls = seen.null_count if seen is not None and seen.has_null_count else None
                    ends = (float(seen.min), float(seen.max)) if seen is not None and seen.has_min_max else (None, None)
                    number = ends[0] is not None and ends[0] == ends[0] and ends[1] == ends[1]
                    known = nulls is not None and (nulls == group.num_rows or (number and (telling or not floating)))
                    yield (uri, g, column.path_in_schema, kind, group.num_rows, nulls, *(ends if number else (None, None)), known, None)

    names = ["uri", "row_group", "column", "type", "n_rows", "n_nulls", "least", "most", "known", "error"]
    schema = "uri string, row_group int, column string, type string, n_rows bigint, n_nulls bigint, least double, most double, known boolean, error string"

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for uri in batch["uri"]:
                try:
                    rows += list(facts(uri))
                except Exception as error:
                    rows.append((uri, None, None, None, None, None, None, None, False, f"{type(error).__name__}: {error}"))
                if len(rows) >= LISTED_ROWS:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
        yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("uri").repartition(n_tasks(files.sparkSession), "uri").mapInPandas(peek, schema)


def scanned_statistics(unknown: DataFrame) -> DataFrame:
    """Rows (uri, column, n_rows, n_nulls, least, most) of the row groups and columns in ``unknown`` (uri, row_group, column), from their
    values; NaN counts as null. A task reads one row group at a time, and of it the named columns only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, g, columns in batch[["uri", "row_group", "columns"]].itertuples(index=False):
                with _open(uri) as stream:
                    table = pyarrow.parquet.ParquetFile(stream).read_row_group(int(g), columns=list(columns))
                rows = []
                for name in columns:
                    values = table.column(name).to_pandas().astype("float64").dropna()
                    rows.append((uri, name, len(table), len(table) - len(values), values.min(), values.max()))
                out = pd.DataFrame(rows, columns=["uri", "column", "n_rows", "n_nulls", "least", "most"])
                yield out.astype(object).where(out.notna(), None)

    pieces = unknown.groupBy("uri", "row_group").agg(F.sort_array(F.collect_set("column")).alias("columns"))  # a row group's columns
    return pieces.mapInPandas(read, "uri string, column string, n_rows bigint, n_nulls bigint, least double, most double")
