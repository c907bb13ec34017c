"""Checks from footers against checks of the rows; which files are read; row groups."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runlens.operators import footers, quality
from runlens.sources import files, tables

COLUMNS = ["a__dl_sch_bler", "a__snr__db_", "b__lost_pdus"]


def bronze(spark, path, odd=()):
    """Six runs of 40 rows; those in ``odd`` hold a NaN."""
    nan = F.when(F.col("run").isin(*odd) & (F.col("i") == 7), F.lit(float("nan"))) if odd else F.lit(None)
    rows = spark.range(240).select((F.col("id") % 6).alias("run"), F.floor(F.col("id") / 6).alias("i")).select(
        F.lit("Tranche_A").alias("tranche"), F.concat(F.lit("Session_"), F.col("run") % 2).alias("session"), F.concat(F.lit("cipheron_"), "run").alias("run_id"),
        F.col("i").alias("ordinal"), "run", "i",
        F.when(F.col("i") % 4 > 0, F.col("i") / 30.0).alias(COLUMNS[0]),
        F.coalesce(nan, F.col("run") * 10.0 - F.col("i")).alias(COLUMNS[1]),
        F.when(F.col("run") == 5, None).otherwise(F.col("i") * 1.0).alias(COLUMNS[2]),
    ).drop("run", "i")
    tables.write_bronze(rows, path, by_run=True)
    return rows


def as_rows(df):
    return sorted((r.check_id, r.subject, None if r.observed is None else round(r.observed, 9), r.status) for r in df.collect())


@pytest.mark.parametrize(("odd", "n_read"), [((), 0), ((2, 4), 2), ((0, 1, 2, 3, 4, 5), 6)])
def test_checks_equal_those_of_the_rows(spark, tmp_path, odd, n_read):
    rows = bronze(spark, str(tmp_path), odd)
    checks, summary, found = footers.footer_checks(spark, str(tmp_path), COLUMNS)
    assert as_rows(checks) == as_rows(quality.value_ranges(rows).unionByName(quality.null_rates(rows)))
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, quality.range_summary(rows).collect()))
    assert (found.n_files >= 6, found.n_read) == (True, n_read)


def test_only_odd_columns_are_read(spark, tmp_path):
    bronze(spark, str(tmp_path), (3,))
    told = files.footer_statistics(files.list_files(spark, str(tmp_path), "*.parquet"))
    (row,) = files.scanned_statistics(told.where(~F.col("known"))).collect()
    assert "run_id=cipheron_3/" in row.uri
    assert (row.column, row.n_rows, row.n_nulls, row.least, row.most) == (COLUMNS[1], 40, 1, -9.0, 30.0)


def test_other_writers_and_broken_files(spark, tmp_path):
    """A writer that passes over NaN is not believed, nor a file without statistics; one that does not open is one row."""
    for run, options in (("cipheron_1", {}), ("cipheron_2", {"write_statistics": False})):
        folder = tmp_path / "tranche=Tranche_A" / "session=Session_1" / f"run_id={run}"
        folder.mkdir(parents=True)
        pq.write_table(pa.table({COLUMNS[0]: [0.5, math.nan, None], "n": [1, 2, 3]}), folder / "x.parquet", **options)
    (tmp_path / "tranche=Tranche_A" / "session=Session_1" / "run_id=cipheron_1" / "y.parquet").write_bytes(b"no parquet")
    told = files.footer_statistics(files.list_files(spark, str(tmp_path), "*.parquet")).collect()
    assert sum(r.error is not None for r in told) == 1
    known = {(r.uri.split("run_id=")[1][:10], r.column): r.known for r in told if r.column}
    assert known == {("cipheron_1", COLUMNS[0]): False, ("cipheron_1", "n"): True, ("cipheron_2", COLUMNS[0]): False, ("cipheron_2", "n"): False}
    (tmp_path / "tranche=Tranche_A" / "session=Session_1" / "run_id=cipheron_1" / "y.parquet").unlink()
    facts = {r.run_id: (r.n_rows, r.n_known, r.least, r.most) for r in footers.column_facts(spark, str(tmp_path), ["dl_sch_bler"]).facts.collect()}
    assert facts == {"cipheron_1": (3, 1, 0.5, 0.5), "cipheron_2": (3, 1, 0.5, 0.5)}


def test_row_groups_are_small_and_sorted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "GROUP_ROWS", 1000)
    rows = spark.range(9000).select(
        F.lit("Tranche_A").alias("tranche"), F.lit("Session_1").alias("session"), F.concat(F.lit("run_"), F.col("id") % 9).alias("run_id"),
        F.floor(F.col("id") / 9).alias("ordinal"), F.col("id").cast("double").alias("v"),
    )
    tables.write_bronze(rows.coalesce(1), str(tmp_path))
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in tmp_path.rglob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert max(g.num_rows for g in groups) <= 1000 and sum(g.num_rows for g in groups) == 9000
    holds = [g for g in groups if g.column(0).statistics.min <= "run_4" <= g.column(0).statistics.max]
    assert groups[0].column(0).path_in_schema == "run_id" and len(holds) <= 3 < len(groups)
    assert spark.read.parquet(str(tmp_path)).where("run_id = 'run_4'").count() == 1000


def test_suite_with_times_and_columns(spark, tmp_path):
    rows = bronze(spark, str(tmp_path)).withColumns({"cipher_state": F.lit("on"), "pdcp_rx__time": F.lit(1.0)})
    found = quality.suite(rows, time="pdcp_rx__time", footers=files.footer_columns(files.list_files(spark, str(tmp_path), "*.parquet")))
    kinds = {r.check_id: r.status for r in found.where("check_id in ('duplicate_timestamps', 'boolean_columns', 'column_counts')").collect()}
    assert kinds == {"duplicate_timestamps": "WARN", "boolean_columns": "PASS", "column_counts": "PASS"}
