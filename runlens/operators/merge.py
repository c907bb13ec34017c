"""Aligning the measurement groups of a run by row position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.ordinal import join_on, row_ordinal, split_places


def group_sizes(df: DataFrame, run: Sequence[str], group: str) -> DataFrame:
    """Rows per (run, group)."""
    return df.groupBy(*run, group).agg(F.count(F.lit(1)).alias("n_rows"))


def shortest_group(sizes: DataFrame, run: Sequence[str]) -> DataFrame:
    """Rows every present group of the run can give."""
    return sizes.groupBy(*run).agg(F.min("n_rows").alias("min_rows"))


def bottleneck_groups(sizes: DataFrame, run: Sequence[str], group: str) -> DataFrame:
    """Each group's rows against the run's minimum; rank 1 truncates the run.

    A run has a few dozen groups at most, so the window is over a handful of rows.
    """
    per_run = Window.partitionBy(*run)
    return sizes.select(
        *run,
        group,
        "n_rows",
        F.min("n_rows").over(per_run).alias("min_rows"),
        F.rank().over(per_run.orderBy("n_rows")).alias("shortness"),
    )


def merge_long(
    df: DataFrame,
    run: Sequence[str],
    group: str,
    order: Sequence[Column | str],
    value: str,
    groups: Sequence[str],
    split: Sequence[str] = (),
) -> DataFrame:
    """Positional merge of one long table: a row per (run, ordinal), a column per group.

    Groups that a run lacks stay null and do not shorten it. Rows are placed across tasks, and the
    merge key includes the ordinal, so a hot run spreads over all tasks. ``split`` names bounded pieces of a group, in whose
    order the group lies: see ``split_places``; ``order`` then holds in a piece.
    """
    columns = [F.max(F.when(F.col(group) == g, F.col(value))).alias(f"{g}__{value}") for g in groups]
    floor = shortest_group(group_sizes(df, run, group), run)
    keys = [*run, group]
    ordered = split_places(df, keys, split, order) if split else row_ordinal(df, keys, order)
    placed = join_on(ordered, floor, run, spread=True)
    kept = placed.where(F.col("ordinal") < F.col("min_rows"))
    return kept.groupBy(*run, "ordinal").agg(*columns)


def merge_frames(
    frames: Mapping[str, DataFrame],
    run: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Positional merge of one frame per group, each with its own double columns.

    The frames are stacked with their columns packed into one array, so each is read once
    and all go through one ``merge_long``.
    """
    keys = [*run, *order]
    own = {name: [c for c in f.columns if c not in keys] for name, f in frames.items()}
    stacked = reduce(DataFrame.unionByName, [
        f.select(*keys, F.lit(name).alias("group"), F.array(*own[name]).alias("values"))
        for name, f in frames.items()
    ])
    wide = merge_long(stacked, run, "group", order, "values", list(frames))
    return wide.select(
        *run, "ordinal",
        *[F.col(f"{name}__values")[i].alias(c) for name in frames for i, c in enumerate(own[name])],
    )
