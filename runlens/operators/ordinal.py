"""Positions, running totals and exact quantiles that survive one huge group.

A window over a group runs in one task. Here a group's rows are counted or totalled per chunk, and each chunk is shifted by
the totals of the chunks before: the same way for groups of every size. Where rows come from files, the chunks are the
ranges they were read in (``split_places``); elsewhere rows are range-partitioned by key and order over the whole cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import stored

def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", spread: bool = False) -> DataFrame:
    """Equi-join in which null keys meet null keys; the left side keeps its columns.

    ``spread`` has both sides shuffled. Rows of a stored step need it: Spark goes by the size of its files, and some million rows that are
    alike take a few megabytes there and gigabytes in a broadcast.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return (left.hint("merge") if spread else left).join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    weight: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``weight`` per key; ``order`` must be unique per key."""
    keys, upto = list(keys), (Window.unboundedPreceding, 0)
    chunked = stored(
        df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()), "chunks"
    )
    chunk_keys = [*keys, "_chunk"]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*chunk_keys)
        .agg(F.sum(weight).alias("_total"))
        .select(*chunk_keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(*upto)
    totalled = chunked.withColumn(name, F.sum(weight).over(inside))
    return (
        join_on(totalled, offsets, chunk_keys, spread=True)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_chunk", "_before")
    )


def row_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "ordinal",
) -> DataFrame:
    """Zero-based position of each row in its group; ``order`` must be unique per key.

    Rows are numbered where the range partitioning has sorted them, and written once. What is known per (key, chunk), its first number and
    its count, then gives the positions: there is no second shuffle and no second sort.
    """
    keys = list(keys)
    sorted_once = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = stored(sorted_once.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    numbered = numbered.withColumn("_chunk", F.shiftright("_at", 33))
    chunk_keys = [*keys, "_chunk"]
    chunks = numbered.groupBy(*chunk_keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shifts = chunks.select(*chunk_keys, (_earlier("_n", keys, ["_chunk"]) - F.col("_first")).alias("_shift"))
    return join_on(numbered, shifts, chunk_keys, spread=True).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_chunk", "_shift")


def _earlier(count: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The sum over the chunks before; a group has few chunks against its rows."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(before), F.lit(0))


def split_places(
    df: DataFrame,
    keys: Sequence[str],
    split: Sequence[str],
    order: Sequence[str],
    name: str = "ordinal",
    size: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, by counts of the splits that its rows were read in.

    ``split``: columns that name the bounded pieces of a group, in their order; ``order`` is unique in a split. A row's position
    is its place in the split plus the rows of the splits before: a window over a split, and a table of counts. Rows are
    neither range-partitioned nor stored. ``size`` names a column with the rows of the group.
    ``df`` is read twice: hand in a stored table, of which the counts read the key columns only.
    """
    keys, pieces = list(keys), [*keys, *split]
    counts = df.groupBy(*pieces).agg(F.count(F.lit(1)).alias("_n"))
    whole = [F.sum("_n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    shifts = counts.select(*pieces, _earlier("_n", keys, split).alias("_before"), *whole)
    inside = F.row_number().over(Window.partitionBy(*pieces).orderBy(*order)).cast("bigint")
    placed = join_on(df.withColumn(name, inside - 1), shifts, pieces, spread=True)
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: dict[str, float],
) -> DataFrame:
    """Interpolated quantiles per key, one column per point; nulls are left out.

    Equal values are counted before anything is ordered, so a hot value is one row.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counts, keys, ["_value"], F.col("_n"), "_upto")
    sizes = ranked.groupBy(*keys).agg(F.max("_upto").alias("_size"))
    if keys:
        ranked = join_on(ranked, sizes, keys, spread=True)
        size = F.col("_size")
    else:
        size = sizes.scalar()

    def value_at(rank: Column) -> Column:
        here = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col("_value")))

    columns, places = [], []
    for label, p in points.items():
        place = (size - 1) * F.lit(float(p))
        columns += [
            value_at(F.floor(place)).alias(f"_lo_{label}"),
            value_at(F.ceil(place)).alias(f"_hi_{label}"),
            F.max(place - F.floor(place)).alias(f"_part_{label}"),
        ]
        places.append(label)
    picked = ranked.groupBy(*keys).agg(*columns)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * F.col(f"_part_{p}")
            ).alias(p)
            for p in places
        ],
    )
