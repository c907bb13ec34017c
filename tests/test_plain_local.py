"""Bronze on a local file system: one file per file, without a checksum file beside it."""

import os

from pyspark.sql import functions as F
from runlens.sources import tables


def test_bronze_has_no_checksum_files(spark, tmp_path):
    rows = spark.range(40).select(
        F.lit("Tranche_A").alias("tranche"), F.concat(F.lit("Session_"), F.col("id") % 4).alias("session"),
        (F.col("id") % 8).cast("string").alias("run_id"), F.col("id").alias("ordinal"), F.col("id").cast("double").alias("x"),
    )
    for by_run in (False, True):
        path = f"{tmp_path}/{by_run}"
        tables.write_bronze(rows, path, by_run=by_run)
        names = [name for _, _, found in os.walk(path) for name in found]
        assert sum(name.endswith(".parquet") for name in names) >= (8 if by_run else 4)
        assert not [name for name in names if name.endswith(".parquet.crc")]
        stored = spark.read.parquet(path).select("tranche", "session", F.col("run_id").cast("string"), "ordinal", "x")
        assert sorted(stored.collect()) == sorted(rows.select(stored.columns).collect())
        tables.write_bronze(rows.where("id < 8"), path, by_run=by_run)  # overwritten as a whole
        assert spark.read.parquet(path).count() == 8
