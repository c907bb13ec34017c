"""Row-wise steps: filters, metadata, types, rounding."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.constants import ESSENTIAL_GROUPS
from runlens.functions.stats import number
from runlens.operators.ordinal import join_on


def filter_groups(df: DataFrame, group: str, groups: Collection[str] = ESSENTIAL_GROUPS) -> DataFrame:
    """Only the groups that feed the features."""
    return df.where(F.col(group).isin(*groups))


def select_tranche(df: DataFrame, tranche: str | None = None) -> DataFrame:
    """One tranche, or all."""
    return df if tranche is None else df.where(F.col("tranche") == tranche)


def filter_runs(df: DataFrame, tranches: Sequence[str], labels: Sequence[str]) -> DataFrame:
    return df.where(F.col("tranche").isin(*tranches) & F.col("cipher_state").isin(*labels))


def split_by_label(df: DataFrame, label: str = "cipher_state") -> tuple[DataFrame, DataFrame]:
    """The on rows and the off rows."""
    return df.where(F.col(label) == "on"), df.where(F.col(label) == "off")


def attach_metadata(df: DataFrame, runs: DataFrame, run: Sequence[str]) -> DataFrame:
    """Put the run's identity columns in front of its rows."""
    identity = [*run, *[c for c in runs.columns if c not in run]]
    joined = join_on(df, runs, run)
    return joined.select(*identity, *[c for c in df.columns if c not in run])


def canonical_types(df: DataFrame, measurements: Sequence[str]) -> DataFrame:
    """Measurements as doubles whatever one file holds; unreadable text and NaN become null."""
    return df.withColumns({c: number(F.col(c)) for c in measurements})


def harmonize(df: DataFrame, fragment: str) -> DataFrame:
    """Columns named by the fragment become floating point."""
    floating = (T.DoubleType, T.FloatType)
    wrong = [f.name for f in df.schema if fragment in f.name and not isinstance(f.dataType, floating)]
    return df.withColumns({c: F.col(c).cast("double") for c in wrong})


def round_columns(df: DataFrame, decimals: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in decimals.items()})


def drop_empty_groups(df: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of ``df`` that still have rows in ``kept``."""
    return join_on(df, kept.select(*keys).distinct(), keys, "left_semi")
