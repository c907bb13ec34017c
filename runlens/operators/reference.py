"""Comparison with a published per-run feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordinal import exact_quantiles, join_on

INDICATOR_NAMES = ("indicator", "cipher_state", "label", "cipher")


def indicator_column(published: DataFrame) -> str | None:
    """The first column that tells the class (1 is on, 0 is off)."""
    return next((c for c in published.columns if c.lower() in INDICATOR_NAMES), None)


def reference_stats(published: DataFrame) -> DataFrame:
    """Mean and median of x15 and x182, and of x15 by class, as far as the columns exist."""
    parts = []
    indicator = indicator_column(published)
    for feature in ("x15", "x182"):
        if feature in published.columns:
            parts.append(published.select(F.lit(feature).alias("feature"), F.lit("all").alias("class"),
                                          F.col(feature).alias("value")))
    if indicator and "x15" in published.columns:
        label = F.when(F.col(indicator) == 1, "on").when(F.col(indicator) == 0, "off")
        parts.append(published.select(F.lit("x15").alias("feature"), label.alias("class"),
                                      F.col("x15").alias("value")))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    keys = ["feature", "class"]
    means = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return join_on(means, exact_quantiles(long, keys, "value", {"median": 0.5}), keys)


def reference_compare(own: DataFrame, published: DataFrame) -> DataFrame:
    """Own and published number of runs per tranche."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tranche").agg(F.count("*").alias(name))

    return count(own, "n_own").join(count(published, "n_published"), "tranche", "full")
