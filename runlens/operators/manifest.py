"""Run outcomes, the manifest, and the reports made from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.constants import MIN_RUN_ROWS
from runlens.functions.labels import (
    label_from_name,
    name_mentions_label,
    normalize_label,
    resolve_label,
)
from runlens.functions.names import run_number
from runlens.operators.ordinal import join_on

RUN = ("tranche", "session", "run_id")


def label_lookup(runs: DataFrame, label_table: DataFrame) -> DataFrame:
    """Left join of run folders to their session's label table, by name.

    Both sides grow with the runs, so the join strategy is left to Spark's size checks.
    """
    labels = label_table.select("tranche", "session", F.col("name").alias("run_id"), "enb")
    return join_on(runs, labels, RUN, "left")


def with_labels(runs: DataFrame, name: str = "run_id", raw: str = "enb") -> DataFrame:
    return runs.withColumns(resolve_label(label_from_name(F.col(name)), normalize_label(F.col(raw))))


def run_census(folders: DataFrame, name: str, group: str) -> DataFrame:
    """On and off runs per session by folder name, and the groups seen there.

    The set holds group names, of which an experiment has a few dozen.
    """
    label = name_mentions_label(F.col(name))
    return folders.groupBy("tranche", "session").agg(
        F.count_distinct(F.when(label == "on", F.col(name))).alias("n_on"),
        F.count_distinct(F.when(label == "off", F.col(name))).alias("n_off"),
        F.array_join(F.array_sort(F.collect_set(group)), ",").alias("groups"),
    )


def run_outcome(
    has_data: Column,
    label: Column,
    n_csv: Column,
    n_groups: Column,
    n_rows: Column,
    min_rows: int = MIN_RUN_ROWS,
) -> dict[str, Column]:
    """Outcome and reason; the first rule that applies decides."""
    # The reasons.
    rules = [
        (~has_data, "skip", F.lit("no traffic_generator folder")),
        (label == "unknown", "quarantine", F.lit("cipher state unknown")),
        (n_csv == 0, "skip", F.lit("no CSV files in traffic_generator")),
        (n_groups == 0, "quarantine", F.lit("all CSV groups empty after trimming")),
        (n_rows < min_rows, "quarantine",
         F.concat(F.lit("too few rows after trimming: "), n_rows.cast("string"))),
    ]
    (test, result, text), *rest = rules
    outcome, reason = F.when(test, result), F.when(test, text)
    for test, result, text in rest:
        outcome, reason = outcome.when(test, result), reason.when(test, text)
    return {"outcome": outcome.otherwise("ok"), "skip_reason": reason.otherwise("")}


def write_failures(manifest: DataFrame, failures: DataFrame) -> DataFrame:
    """Runs whose output could not be written go to quarantine with the reason."""
    joined = join_on(manifest, failures.select(*RUN, "write_error"), RUN, "left")
    failed = F.col("write_error").isNotNull() & (F.col("outcome") == "ok")
    return joined.withColumns({
        "outcome": F.when(failed, "quarantine").otherwise(F.col("outcome")),
        "skip_reason": F.when(
            failed, F.concat(F.lit("Parquet write failed: "), F.col("write_error"))
        ).otherwise(F.col("skip_reason")),
    }).drop("write_error")


def min_rows_filter(df: DataFrame, run: Sequence[str], min_rows: int = MIN_RUN_ROWS) -> DataFrame:
    """Rows of runs that have enough of them."""
    enough = df.groupBy(*run).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    return join_on(df, enough, run, "left_semi")


def build_manifest(runs: DataFrame, measured: DataFrame, min_rows: int = MIN_RUN_ROWS) -> DataFrame:
    """One row per run folder, whether or not anything could be read from it.

    ``runs``: run keys, ``enb``, ``has_data``, ``n_csv``, ``raw_size_bytes``, ``measurement_ts``.
    ``measured``: run keys, ``csv_files_read``, ``row_count``, ``col_count``.
    Files are looked at only where the run has a data folder, CSVs and a known label; elsewhere
    sizes and counts are 0 and there is no start time. The label of a run without a data folder is not
    looked at either: it is unknown, from no source, and mismatches nothing.
    """
    labelled = with_labels(join_on(runs, measured, RUN, "left"))
    unread = {"cipher_state": "unknown", "cipher_source": "none", "label_mismatch": False}
    joined = labelled.withColumns({c: F.when(F.col("has_data"), F.col(c)).otherwise(F.lit(v)) for c, v in unread.items()})
    counts = ("csv_files_read", "row_count", "col_count")
    looked = F.col("has_data") & (F.col("cipher_state") != "unknown") & (F.col("n_csv") > 0)
    filled = joined.fillna(0, list(counts)).withColumns({
        "measurement_ts": F.when(looked, F.col("measurement_ts")),
        "raw_size_bytes": F.when(looked, F.col("raw_size_bytes")).otherwise(0),
        "csv_files_read": F.when(looked, F.col("csv_files_read")).otherwise(0),
    })
    decided = filled.withColumns(run_outcome(
        F.col("has_data"), F.col("cipher_state"), F.col("n_csv"),
        F.col("csv_files_read"), F.col("row_count"), min_rows,
    ))
    ok = F.col("outcome") == "ok"
    return decided.select(
        "run_id", run_number(F.col("run_id")).alias("run_number"), "tranche", "session",
        "cipher_state", "cipher_source", "label_mismatch", "measurement_ts",
        *[F.when(ok, F.col(c)).otherwise(0).alias(c) for c in ("row_count", "col_count")],
        "csv_files_read", "raw_size_bytes", "outcome", "skip_reason",
    )


def quarantined(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("outcome") == "quarantine")


def ok_runs(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("outcome") == "ok")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Outcome counts, sizes and the raw-to-stored ratio (0 when nothing was stored)."""
    def having(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return manifest.agg(
        having("ok").alias("n_ok"),
        having("quarantine").alias("n_quarantine"),
        having("skip").alias("n_skip"),
        F.count_if("label_mismatch").alias("n_mismatch"),
        F.sum("raw_size_bytes").alias("raw_bytes"),
        F.sum("parquet_size_bytes").alias("stored_bytes"),
    ).withColumn(
        "size_ratio", F.coalesce(F.try_divide("raw_bytes", "stored_bytes"), F.lit(0.0))
    )


def size_report(manifest: DataFrame) -> DataFrame:
    """Runs and gigabytes per tranche and in total (tranche null), of ok runs."""
    def gigabytes(column: str) -> Column:
        return F.round(F.sum(column) / 1e9, 2)

    return ok_runs(manifest).rollup("tranche").agg(
        F.count("*").alias("n_runs"),
        gigabytes("raw_size_bytes").alias("raw_gb"),
        gigabytes("parquet_size_bytes").alias("stored_gb"),
        F.coalesce(
            F.try_divide(F.sum("raw_size_bytes"), F.sum("parquet_size_bytes")), F.lit(0.0)
        ).alias("size_ratio"),
    )


def reject_reasons(manifest: DataFrame) -> DataFrame:
    """Quarantined runs by reason, most frequent first."""
    counts = quarantined(manifest).groupBy("skip_reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "skip_reason")


def missing_files(manifest: DataFrame, files: DataFrame, path: str = "parquet_path") -> DataFrame:
    """Ok runs whose stored file is not among the listed ones."""
    return join_on(ok_runs(manifest), files.select(path), [path], "left_anti")


def incomplete_runs(manifest: DataFrame, log: DataFrame) -> DataFrame:
    """Manifest runs without a passing entry in the pipeline log."""
    passed = log.where(F.col("status") == "pass").select("run_id")
    return join_on(manifest, passed, ["run_id"], "left_anti")
