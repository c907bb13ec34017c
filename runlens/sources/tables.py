"""Stored tables: Bronze, Silver, manifest, catalogue."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.constants import CATALOGUE_HEADERS, SHEETS
from runlens.functions.stats import number
from runlens.session import few_listing_tasks

BRONZE_IDENTITY = (
    "run_id string, run_number bigint, cipher_state string, tranche string, session string,"
    " measurement_ts string, label_mismatch boolean"
)
MANIFEST_SCHEMA = (
    "run_id string, run_number bigint, tranche string, session string, cipher_state string,"
    " cipher_source string, label_mismatch boolean, measurement_ts string, row_count bigint,"
    " col_count bigint, csv_files_read bigint, raw_size_bytes bigint, parquet_size_bytes bigint,"
    " parquet_path string, outcome string, skip_reason string, processed_at string"
)
FILE_ROWS = 5_000_000
GROUP_ROWS = 50_000  # rows of a Parquet row group
# On a local file system without native code Hadoop starts a chmod process for every folder, every file and every checksum file.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def bronze_schema(measurements: Sequence[str]) -> T.StructType:
    """Canonical schema: every measurement is a double whatever single files hold."""
    identity = T.StructType.fromDDL(BRONZE_IDENTITY)
    return T.StructType([*identity, *[T.StructField(m, T.DoubleType()) for m in measurements]])


def read_bronze(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Files of differing columns and number types as one table; missing columns are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    with few_listing_tasks(spark):
        return spark.read.schema(schema).parquet(*paths)


def write_bronze(df: DataFrame, path: str, order: Sequence[str] = ("ordinal",), by_run: bool = False) -> None:
    """Snappy Parquet by tranche and session, and by run where asked for. Range partitioning keeps a
    run's rows together and still spreads a huge run over many tasks and files. Rows are sorted by run and order, in row groups
    of at most ``GROUP_ROWS``, so a filter on runs or times skips most groups."""
    bronze_writer(by_run)(bronze_rows(df, order).write.mode("overwrite")).parquet(path)


def bronze_rows(df: DataFrame, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Rows in the order in which Bronze is stored."""
    keys = ["tranche", "session", "run_id", *[c for c in order if c in df.columns]]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def bronze_writer(by_run: bool = False) -> Callable[[DataFrameWriter], DataFrameWriter]:
    """Partitions and options of Bronze, for ``write_bronze`` and for ``versions``."""
    return lambda writer: (
        writer.partitionBy("tranche", "session", *["run_id"] * by_run)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", FILE_ROWS)
        .option("parquet.block.row.count.limit", GROUP_ROWS)
        .options(**PLAIN_LOCAL)
    )


def write_table(df: DataFrame, path: str) -> None:
    """Create or replace a stored table."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """CSV cannot tell an empty text from a missing one; only a timestamp may be missing here."""
    raw = spark.read.schema(schema).option("header", "true").csv(path)
    texts = [name for name, kind in raw.dtypes if kind == "string" and name != "measurement_ts"]
    return raw.fillna("", texts)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every value a stripped string (the feature dictionary's form)."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue export: columns without a name and rows without a value are dropped. Cells may hold line breaks."""
    raw = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    named = [c for c in raw.columns if not re.fullmatch(r"_c\d+", c)]
    cells = [F.col(f"`{c}`") for c in named]
    return raw.select(*cells).where(F.coalesce(*cells).isNotNull())


def read_sheets(spark: SparkSession, folder: str, sheets: Mapping[str, str] = SHEETS) -> dict[str, DataFrame]:
    """The sheets of a workbook that was exported as one CSV per sheet, named like it. Each has its own headers."""
    return {key: read_catalogue(spark, f"{folder.rstrip('/')}/{name}.csv") for key, name in sheets.items()}


def named_catalogue(sheet: DataFrame) -> DataFrame:
    """The catalogue sheet under short names, its numbers as numbers; a column that the sheet lacks is null.

    A sheet has no order that Spark keeps, so ``pos`` is there only if the export has it.
    """
    kinds = {"priority": "bigint", "min_value": "double", "max_value": "double"}
    columns = [
        (F.col(f"`{header}`") if header in sheet.columns else F.lit(None)).try_cast(kinds.get(name, "string")).alias(name)
        for header, name in CATALOGUE_HEADERS.items()
    ]
    return sheet.select(*[F.col("pos").try_cast("bigint").alias("pos")] * ("pos" in sheet.columns), *columns)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Published features: ``x`` columns and class indicators as doubles, the rest as text."""
    raw = spark.read.option("header", "true").csv(path)
    numeric = re.compile(r"x\d+|indicator|label|cipher|cipher_state", re.IGNORECASE)
    return raw.select(*[
        (number(F.col(f"`{c}`")) if numeric.fullmatch(c) else F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ])
