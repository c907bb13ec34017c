"""Aggregate expressions shared by the feature queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sketch keeps about this many values, however many rows a run has.
ACCURACY = 100_000


def number(raw: Column) -> Column:
    """Double that is null for blanks, unreadable text and NaN."""
    value = raw.try_cast("double")
    return F.when(~F.isnan(value), value)


def quantiles(value: Column, points: Sequence[float], accuracy: int = ACCURACY) -> Column:
    """All points from one sketch; separate calls would build one sketch each.

    A rank is off by at most rows / ``accuracy``; up to about ``accuracy`` rows the answer is exact.
    """
    return F.percentile_approx(value, [float(p) for p in points], accuracy)


def share(condition: Column) -> Column:
    """Share of rows that meet the condition; null rows count below the line."""
    return F.count_if(condition) / F.count(F.lit(1))


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum across columns, null when any part is null."""
    return reduce(add, columns)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)
