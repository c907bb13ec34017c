"""Comparing the two classes: means, gaps, quantiles, separation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.stats import percent
from runlens.operators.ordinal import exact_quantiles, join_on

LABEL = "cipher_state"
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
CURVE = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def class_balance(df: DataFrame, keys: Sequence[str], label: str = LABEL) -> DataFrame:
    """Runs per class and share of on, by any keys."""
    counts = df.groupBy(*keys).agg(
        F.count_if(F.col(label) == "on").alias("n_on"),
        F.count_if(F.col(label) == "off").alias("n_off"),
    )
    total = F.col("n_on") + F.col("n_off")
    return counts.withColumn("pct_on", percent(F.col("n_on"), total))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def overview(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col(label) == "on").alias("n_on"),
        F.count_if(F.col(label) == "off").alias("n_off"),
    )


def run_count_rollup(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Session rows, tranche subtotals and the grand total, with the number of sessions."""
    return df.rollup("tranche", "session").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count_if(F.col(label) == "on").alias("n_on"),
        F.count_if(F.col(label) == "off").alias("n_off"),
        F.count("*").alias("n_runs"),
        F.count_distinct("tranche", "session").alias("n_sessions"),
    )


def row_count_stats(runs: DataFrame, rows: str = "row_count") -> DataFrame:
    """Smallest, median and largest run."""
    middle = exact_quantiles(runs, [], rows, {"median_rows": 0.5})
    return runs.agg(
        F.min(rows).alias("min_rows"),
        F.max(rows).alias("max_rows"),
    ).withColumn("median_rows", middle.scalar())


def class_mean(df: DataFrame, kpis: Sequence[str], label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(k).alias(k) for k in kpis])


def class_gap(df: DataFrame, kpis: Sequence[str], label: str = LABEL) -> DataFrame:
    """On against off per KPI: means, absolute gap, gap in percent of off.

    All means come from one aggregate; its single row is unfolded afterwards.
    """
    means = df.agg(*[
        F.avg(F.when(F.col(label) == c, F.col(k))).alias(f"{k}_{c}") for k in kpis for c in ("off", "on")
    ])
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("kpi"),
            F.col(f"{k}_off").alias("mean_off"),
            F.col(f"{k}_on").alias("mean_on"),
        )
        for k in kpis
    ])
    gap = F.col("mean_on") - F.col("mean_off")
    return means.select(F.inline(rows)).withColumns(
        {"gap": gap, "gap_pct": percent(gap, F.abs("mean_off"))}
    )


def kpi_direction(
    df: DataFrame,
    kpis: Sequence[str],
    tolerance_pct: float = 0.1,
    higher: Mapping[str, str] | None = None,
) -> DataFrame:
    """Which way on differs from off; ``higher`` renames the upward direction of a KPI."""
    up: Column = F.lit("higher")
    for name, word in (higher or {}).items():
        up = F.when(F.col("kpi") == name, word).otherwise(up)
    direction = (
        F.when((F.col("mean_on") == 0) & (F.col("mean_off") == 0), "zero in both")
        .when(F.abs("gap_pct") < tolerance_pct, "no difference")
        .when(F.col("gap") < 0, "lower")
        .otherwise(up)
    )
    return class_gap(df, kpis).select("kpi", "gap_pct", direction.alias("direction"))


def class_quantile_curve(
    df: DataFrame,
    kpi: str,
    label: str = LABEL,
    points: Mapping[str, float] = CURVE,
) -> DataFrame:
    """Exact quantiles of a KPI per class, one row per point."""
    wide = exact_quantiles(df, [label], kpi, dict(points))
    return wide.unpivot(label, list(points), "quantile", "value")


def class_separation(
    df: DataFrame,
    kpi: str,
    low: str = "off",
    high: str = "on",
    label: str = LABEL,
) -> DataFrame:
    """Do the middle halves separate, and do the tails still overlap?"""
    quartiles = exact_quantiles(df, [label], kpi, QUARTILES)
    ends = df.groupBy(label).agg(F.min(kpi).alias("least"), F.max(kpi).alias("most"))
    both = join_on(quartiles, ends, [label])

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col(label) == side, F.col(column)))

    return both.agg(
        of(high, "q25").alias("high_q25"),
        of(low, "q75").alias("low_q75"),
        of(low, "most").alias("low_max"),
        of(high, "least").alias("high_min"),
    ).withColumns({
        "iqr_separated": F.col("high_q25") > F.col("low_q75"),
        "tails_overlap": F.col("low_max") >= F.col("high_min"),
    })


def box_stats(
    df: DataFrame, kpi: str, label: str = LABEL
) -> DataFrame:
    """Box plot per class: quartiles, whisker ends, points beyond the 1.5 IQR fences."""
    boxes = exact_quantiles(df, [label], kpi, QUARTILES)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col(kpi).between(F.col("q25") - reach, F.col("q75") + reach)
    per_class = join_on(df.select(label, kpi).where(F.col(kpi).isNotNull()), boxes, [label])
    return per_class.groupBy(label, *QUARTILES).agg(
        F.min(F.when(inside, F.col(kpi))).alias("whisker_low"),
        F.max(F.when(inside, F.col(kpi))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def histogram(df: DataFrame, value: str, bins: int, label: str = LABEL) -> DataFrame:
    """Equal-width bins over the range of all rows, counted per class.

    The range is a scalar subquery, so no row is joined to anything.
    """
    known = df.where(F.col(value).isNotNull())
    low = known.agg(F.min(value)).scalar()
    high = known.agg(F.max(value)).scalar()
    width = (high - low) / bins
    place = F.when(width > 0, F.floor((F.col(value) - low) / width)).otherwise(0)
    binned = known.select(label, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    return binned.groupBy(label, "bin").agg(F.count("*").alias("n"))
