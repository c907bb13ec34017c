"""A training corpus from raw documents: stages in order, each written as Parquet and read again by the next.

Every stage takes an empty table (no rows come out), null or repeated ids, repeated rows, null, empty and very long texts, and
extra columns, which all stages but the last return; what becomes of such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import decontamination, mixing, near_dups, quality_rules, sharding
from runlens.session import scratch_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have fewer than ten words and go."""
    return quality_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of repeated rows, one. Documents without words stay."""
    return near_dups.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole and partial documents in the proportions of the source weights. Documents without words leave; no column may be named ``__round``."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("rules", rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None  # the rules' accuracies come from an iteration that SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
