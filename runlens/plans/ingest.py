"""From a tree of raw files to Bronze and its manifest, as one set of Spark jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.constants import MIN_RUN_ROWS, TRIM_SECONDS
from runlens.operators.manifest import RUN, build_manifest, label_lookup, ok_runs, quarantined, write_failures
from runlens.operators.merge import merge_long
from runlens.operators.ordinal import join_on
from runlens.session import stored
from runlens.sources import versions
from runlens.sources.csv_groups import (
    FILE, LINE, SPLIT, all_columns, header_names, measurement_columns, present_columns, read_groups, repeated_groups, trim_groups,
)
from runlens.sources.files import csv_headers, list_files, path_parts, run_sizes, run_tree, walk, within_runs
from runlens.sources.label_db import label_files, label_table
from runlens.sources.tables import MANIFEST_SCHEMA, bronze_rows, bronze_writer, read_manifest, write_bronze, write_csv, write_table

IDENTITY = ("run_id", "run_number", "cipher_state", "tranche", "session", "measurement_ts", "label_mismatch")


@dataclass(frozen=True)
class Ingested:
    bronze: DataFrame
    manifest: DataFrame


def ingest(
    spark: SparkSession,
    root: str,
    columns: Mapping[str, Sequence[str]] | None = None,
    labels: DataFrame | None = None,
    trim_seconds: float = TRIM_SECONDS,
    min_rows: int = MIN_RUN_ROWS,
    partitioned: bool = False,
    groups: Sequence[str] | None = None,
) -> Ingested:
    """Read, trim and align the groups in ``columns`` (tag to measurement names).

    Without ``columns`` every column of every group is kept, or of the groups whose tags are in ``groups``; a
    column that a file lacks is null for its run. Measurements are doubles; a cell that is no number is null.
    ``partitioned`` says that the tree has ``key=value`` folders. Every run is a key in one plan; there is no loop over
    runs. Run folders are found by a walk, so a run without any file has its manifest row too. Two steps are stored in the shared folder because several later steps read them: the parsed rows and the
    trimmed rows. A run with two files of one group is a failed write, as their columns collide.
    """
    tree = run_tree(walk(spark, root, within_runs))
    runs = run_sizes(tree)
    data = tree.where("is_csv")
    picked = groups if columns is None else list(columns)
    wanted = data if picked is None else data.where(F.col("tag").isin(*picked))
    headers = stored(csv_headers(wanted), "headers")
    described = header_names(wanted, headers)
    columns = all_columns(described) if columns is None else columns
    table = label_table(label_files(spark, root)) if labels is None else labels
    if not columns:  # nothing to read
        none = runs.select(*RUN, *[F.lit(0).alias(c) for c in ("csv_files_read", "row_count", "col_count")]).limit(0)
        manifest = build_manifest(label_lookup(runs, table), none, min_rows)
        return Ingested(ok_runs(manifest).select(*IDENTITY, F.lit(0).cast("long").alias("ordinal")), manifest)
    failures = repeated_groups(described)
    parsed = stored(read_groups(spark, root, tree, headers, columns, partitioned), "rows")
    trimmed = stored(trim_groups(parsed, trim_seconds), "trimmed")

    single = join_on(trimmed, failures, RUN, "left_anti")
    wide = merge_long(single, RUN, "tag", LINE, "values", list(columns), SPLIT)
    merged = wide.select(*RUN, "ordinal", *measurement_columns(columns))
    present = present_columns(described, columns)
    sizes = trimmed.groupBy(*FILE).agg(F.count("*").alias("n"))
    measured = join_on(sizes, present, FILE, "left").groupBy(*RUN).agg(
        F.count("*").alias("csv_files_read"),
        F.min("n").alias("row_count"),
        (F.sum("n_columns") + len(IDENTITY)).alias("col_count"),
    )
    manifest = write_failures(build_manifest(label_lookup(runs, table), measured, min_rows), failures)
    identity = ok_runs(manifest).select(*IDENTITY)
    bronze = join_on(merged, identity, RUN, spread=True).select(
        *identity.columns, "ordinal", *[c for c in merged.columns if "__" in c]
    )
    return Ingested(bronze, manifest)


def stored_runs(listed: DataFrame) -> DataFrame:
    """Run keys, ``parquet_path`` and ``parquet_size_bytes`` of listed files (uri, length) of Bronze that was stored by run."""
    parts = path_parts(F.col("uri"))
    runs = listed.select(
        parts["tranche"].alias("tranche"), parts["session"].alias("session"), parts["run_id"].alias("run_id"),
        F.regexp_replace("uri", "/[^/]+$", "").alias("parquet_path"), "length",
    )
    return runs.groupBy(*RUN).agg(F.min("parquet_path").alias("parquet_path"), F.sum("length").alias("parquet_size_bytes"))


def ingest_to(spark: SparkSession, root: str, out: str, versioned: bool = False, **options) -> DataFrame:
    """Ingest into ``out``/bronze, /manifest and /quarantine; the manifest, read back.

    What the manifest says of stored files comes from a listing after the write: an ok run without files was not written. With
    ``versioned`` the three are tables of ``sources.versions``: readers of the last version go on while an ingest runs, and an
    ingest that dies leaves it in place. Otherwise folders are overwritten.
    """
    done = ingest(spark, root, **options)
    if versioned:
        versions.replace(bronze_rows(done.bronze), f"{out}/bronze", bronze_writer(by_run=True))
        files = versions.files(spark, f"{out}/bronze")
    else:
        write_bronze(done.bronze, f"{out}/bronze", by_run=True)
        files = list_files(spark, f"{out}/bronze", "*.parquet")
    listed = stored_runs(files)
    lost = join_on(ok_runs(done.manifest), listed, RUN, "left_anti").select(*RUN, F.lit("no file was written").alias("write_error"))
    ordered = [field.split()[0] for field in MANIFEST_SCHEMA.split(",")]
    final = finish_manifest(done.manifest, listed, lost).select(*ordered)
    if versioned:
        versions.replace(final, f"{out}/manifest")
        manifest = versions.read(spark, f"{out}/manifest")
        versions.replace(quarantined(manifest), f"{out}/quarantine")
        return manifest
    write_csv(final, f"{out}/manifest")
    manifest = read_manifest(spark, f"{out}/manifest")
    write_table(quarantined(manifest), f"{out}/quarantine")
    return manifest


def finish_manifest(
    manifest: DataFrame, stored: DataFrame, failures: DataFrame | None = None
) -> DataFrame:
    """Add the stored size and path of each run, and what could not be written.

    ``stored``: run keys, ``parquet_path``, ``parquet_size_bytes``.
    """
    checked = manifest if failures is None else write_failures(manifest, failures)
    return (
        join_on(checked, stored, RUN, "left")
        .fillna({"parquet_size_bytes": 0, "parquet_path": ""})
        .withColumn("processed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    )
