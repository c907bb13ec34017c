"""Quantile and proportion features per run, long and wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.constants import QUANTILES, SHORT_QUANTILES
from runlens.functions.stats import ACCURACY, quantiles, share


def feature_quantiles(
    df: DataFrame,
    run: str,
    measurands: Sequence[str],
    points: Sequence[float] = QUANTILES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Rows (run, measurand, feature_type, feature_value, value).

    Aggregated wide and unfolded afterwards: the measurement rows are not multiplied.
    """
    aggregates = [quantiles(F.col(m), points, accuracy).alias(m) for m in measurands]
    wide = df.groupBy(run).agg(*aggregates)
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("measurand"),
            F.lit("quantile").alias("feature_type"),
            F.lit(str(p)).alias("feature_value"),
            F.col(m)[i].alias("value"),
        )
        for m in measurands
        for i, p in enumerate(points)
    ])
    return wide.select(run, F.inline(rows))


def short_quantiles(df: DataFrame, run: str, measurands: Sequence[str]) -> DataFrame:
    """The three-point form."""
    return feature_quantiles(df, run, measurands, SHORT_QUANTILES)


def feature_proportions(df: DataFrame, run: str, measurands: Mapping[str, int]) -> DataFrame:
    """Share of a run's readings at each value of a discrete measurand.

    ``measurands`` maps a column to the decimals its readings are rounded to. Counting
    combines before the shuffle, so the window sees one row per distinct reading, of which a
    discrete measurand has few. Joining totals instead would read the measurements twice.
    """
    readings = df.select(run, *[F.round(m, d).alias(m) for m, d in measurands.items()])
    counts = (
        readings.unpivot(run, list(measurands), "measurand", "reading")
        .where(F.col("reading").isNotNull())
        .groupBy(run, "measurand", "reading")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(run, "measurand"))
    return counts.select(run, "measurand", "reading", "n", (F.col("n") / total).alias("value"))


def feature_matrix(
    long: DataFrame, run: str, feature: str, value: str, features: Sequence[str]
) -> DataFrame:
    """Long features to one row per run; the listed columns need no discovery pass."""
    return long.groupBy(run).pivot(feature, list(features)).agg(F.first(value))


@dataclass(frozen=True)
class Benchmark:
    """A published feature: share of readings at ``at``, or the quantile ``at``."""

    name: str
    column: str
    kind: str
    at: float
    low: float | None = None
    high: float | None = None
    decimals: int = 1


# Definition and expected range of the published features.
BENCHMARKS = (
    Benchmark("x15", "l1_powers__real_rsrq__pcc__db_", "share", -10.5),
    Benchmark("x42", "l1_dl_carrier__dl_sch_bler", "quantile", 0.95),
    Benchmark("x148", "l1_dl_carrier__retransmission_1", "share", 0.0, 0.925, 0.945),
    Benchmark("x182", "mac_rx__mean_pdu_size_bytes_", "quantile", 0.25, 268.2, 268.7),
)


def benchmark_features(
    df: DataFrame,
    run: str,
    benchmarks: Sequence[Benchmark] = BENCHMARKS,
) -> DataFrame:
    """Published features per run, with a flag for those that have an expected range."""
    aggregates, flags = [], []
    for b in benchmarks:
        if b.kind == "share":
            value = share(F.round(b.column, b.decimals) == b.at)
        else:
            value = quantiles(F.col(b.column), [b.at])[0]
        aggregates.append(value.alias(b.name))
        if b.low is not None:
            flags.append(F.col(b.name).between(b.low, b.high).alias(f"{b.name}_in_range"))
    used = list(dict.fromkeys(b.column for b in benchmarks))
    wide = df.groupBy(run).agg(*aggregates)
    return wide.select(run, *[b.name for b in benchmarks], *flags)
