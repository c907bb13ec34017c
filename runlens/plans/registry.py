"""Registered queries: a Spark job, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.plans.views import View


@dataclass(frozen=True)
class Tables:
    """The tables of one scale."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, source: View | str) -> DataFrame:
        if isinstance(source, View):
            return source.load(self.spark, self.sf_dir)
        return self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register a job under a key."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(build, sql)
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Both engines add floating-point numbers in their own order: compare rounded values."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
