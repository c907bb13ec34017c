"""Checks of stored measurements answered from Parquet footers; only files whose footers cannot tell are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.constants import NULL_RATE_FRAGMENTS, VALUE_RANGES
from runlens.operators.quality import range_summary, result, value_ranges
from runlens.session import stored
from runlens.sources.files import footer_statistics, list_files, path_parts, scanned_statistics


@dataclass(frozen=True)
class Facts:
    """Per run and number column: n_rows, n_known (values neither null nor NaN), least, most; and how many files were read for it."""

    facts: DataFrame
    n_files: int
    n_read: int


def column_facts(spark: SparkSession, path: str, fragments: Sequence[str]) -> Facts:
    """Facts of the number columns whose name contains a fragment, of Bronze stored by run (``write_bronze(by_run=True)``).

    The footers of all files are read in tasks. Where a column's statistics are absent from a row group or may hide a NaN, that
    column of that row group is read instead. A column that a file lacks has no row. Files that do not open have
    no facts; ``quality.readable`` reports them.
    """
    listed = list_files(spark, path, "*.parquet")
    told = stored(footer_statistics(listed), "footers").where(F.col("error").isNull())
    wanted = told.where(F.col("column").rlike("|".join(fragments)))
    n_files, n_read = wanted.agg(F.count_distinct("uri"), F.count_distinct(F.when(~F.col("known"), F.col("uri")))).first()
    names = ["uri", "column", "n_rows", "n_nulls", "least", "most"]
    found = wanted.where("known").select(*names)
    if n_read:
        found = found.unionByName(scanned_statistics(wanted.where(~F.col("known"))))
    run = path_parts(F.col("uri"))["run_id"]
    facts = found.groupBy(run.alias("run_id"), "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_rows") - F.col("n_nulls")).alias("n_known"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    return Facts(facts, n_files, n_read)


def ends(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two rows per run, of the least and the most values: the checks of ranges ask for no others."""
    wide = facts.groupBy("run_id").pivot("column", list(columns)).agg(F.first(F.struct("least", "most")).alias("x"))
    return wide.select("run_id", *[F.col(f"`{c}`.least").alias(c) for c in columns]).unionByName(
        wide.select("run_id", *[F.col(f"`{c}`.most").alias(c) for c in columns])
    )


def null_rates(facts: DataFrame, fragments: Sequence[str] = NULL_RATE_FRAGMENTS, limit: float = 0.01) -> DataFrame:
    """As ``quality.null_rates``: the mean over the runs that have a column of its share of nulls."""
    known = facts.where(F.col("column").rlike("|".join(fragments)))
    rates = known.withColumn("rate", 1 - F.col("n_known") / F.col("n_rows")).groupBy("column").agg(F.avg("rate").alias("rate"))
    return result(rates, "null_rates", "column", F.col("column"), F.col("rate"), f"<= {limit}", F.col("rate") <= limit, "WARN")


def footer_checks(spark: SparkSession, path: str, columns: Sequence[str], ranges: Mapping = VALUE_RANGES) -> tuple[DataFrame, DataFrame, Facts]:
    """Results of the range and null checks, the summary of violated ranges, and the facts they came from.

    ``columns``: the floating-point columns of the table; whole numbers have no range, as in ``quality.value_ranges``.
    """
    found = column_facts(spark, path, list(dict.fromkeys([*ranges, *NULL_RATE_FRAGMENTS])))
    kept = stored(found.facts, "facts")
    limits = ends(kept, [c for c in columns if any(f in c for f in ranges)])
    checks = value_ranges(limits, "run_id", ranges).unionByName(null_rates(kept))
    return checks, range_summary(limits, "run_id", ranges), Facts(kept, found.n_files, found.n_read)
