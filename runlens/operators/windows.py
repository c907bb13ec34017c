"""Top-k, positions and set operations on run tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.ordinal import row_ordinal


def head_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "place"
) -> DataFrame:
    """First k rows of each group. Spark cuts to k per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def every_nth(
    runs: DataFrame, order: Sequence[Column | str], n: int
) -> DataFrame:
    """Every n-th run in path order (a sampling report; the checks themselves use all runs)."""
    placed = row_ordinal(runs, [], order, "place").withColumn("place", F.col("place") + 1)
    return placed.where(F.col("place") % n == 0)


def first_match(pairs: DataFrame, keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """Value of the lowest rank per key, combined before the shuffle."""
    return pairs.groupBy(*keys).agg(F.min(rank).alias(rank), F.min_by(value, rank).alias(value))


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of frames whose columns differ; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def either(df: DataFrame, tests: Sequence[tuple[str, Column]], name: str = "kind") -> DataFrame:
    """Union of disjoint filters in one pass, tagged by the test that holds."""
    (label, test), *rest = tests
    kind = reduce(lambda acc, t: acc.when(t[1], t[0]), rest, F.when(test, label))
    return df.withColumn(name, kind).where(F.col(name).isNotNull())
