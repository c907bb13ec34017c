"""Cutting the edges off a run's measurement groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.constants import ROW_TRIM_MAX, ROW_TRIM_SHARE
from runlens.operators.ordinal import join_on, row_ordinal, split_places


def time_trim(df: DataFrame, keys: Sequence[str], time: str, margin: Column) -> DataFrame:
    """Keep rows inside [first + margin, last - margin] of their group, ends included.

    The bounds are an aggregate joined back, not a window: a hot group is read by many tasks.
    """
    bounds = df.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    inside = F.col(time).between(F.col("_first") + margin, F.col("_last") - margin)
    return join_on(df, bounds, keys).where(inside).drop("_first", "_last")


def edge_rows(rows: Column) -> Column:
    """How many rows the row-based trim cuts at each end."""
    cut = F.least(F.lit(ROW_TRIM_MAX), F.greatest(F.lit(1), F.floor(rows / ROW_TRIM_SHARE)))
    return F.when(rows > cut * 2, cut).otherwise(F.lit(0)).cast("bigint")


def row_trim(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    split: Sequence[str] = (),
) -> DataFrame:
    """Without a time column: cut a few rows at both ends of each group; ``split`` as in ``merge_long``."""
    if split:
        placed = split_places(df, keys, split, order, "_place", "_rows")
    else:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        placed = join_on(row_ordinal(df, keys, order, "_place"), sizes, keys, spread=True)
    cut = edge_rows(F.col("_rows"))
    kept = (F.col("_place") >= cut) & (F.col("_place") < F.col("_rows") - cut)
    return placed.where(kept).drop("_place", "_rows")
