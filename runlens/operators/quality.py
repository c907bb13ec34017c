"""Data-quality checks. Every check returns rows of one schema:

``check_id, scope, subject, observed (double), expected, status, severity``.
Status is PASS or the severity (FAIL or WARN). Verdicts count statuses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.constants import (
    KPI_RANGES,
    NULL_RATE_FRAGMENTS,
    RSRP_RANGE,
    RUN_ROWS_RANGE,
    VALUE_RANGES,
)
from runlens.operators.compare import class_balance
from runlens.operators.ordinal import exact_quantiles, join_on
from runlens.operators.windows import head_per_group
from runlens.session import materialize

RESULT = ("check_id", "scope", "subject", "observed", "expected", "status", "severity")
BLOCKING = ("boolean_columns", "label_valid", "balance_session", "duplicate_timestamps", "readable")


def _text(value: str | Column) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value)


def result(
    df: DataFrame,
    check_id: str,
    scope: str | Column,
    subject: str | Column,
    observed: Column,
    expected: str | Column,
    passed: Column,
    severity: str = "FAIL",
) -> DataFrame:
    return df.select(
        F.lit(check_id).alias("check_id"),
        _text(scope).alias("scope"),
        _text(subject).alias("subject"),
        observed.cast("double").alias("observed"),
        _text(expected).alias("expected"),
        F.when(passed, "PASS").otherwise(severity).alias("status"),
        F.lit(severity).alias("severity"),
    )


def combine(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def between_text(low: float, high: float) -> str:
    return f"[{low}, {high}]"


# --- measurement rows -----------------------------------------------------------------


def label_valid(df: DataFrame, run: str = "run_id", label: str = "cipher_state") -> DataFrame:
    """All rows of a run carry on or off."""
    bad = F.count_if(F.col(label).isNull() | ~F.col(label).isin("on", "off"))
    runs = df.groupBy(run).agg(bad.alias("bad"))
    return result(runs, "label_valid", "run", F.col(run), F.col("bad"), "on or off", F.col("bad") == 0)


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def _ranged_columns(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> list[tuple]:
    return [
        (column, fragment, float(low), float(high))
        for fragment, (low, high) in ranges.items()
        for column in _floats(df)
        if fragment in column.lower()
    ]


def value_extremes(
    df: DataFrame,
    run: str = "run_id",
    ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES,
) -> DataFrame:
    """Per run and ranged column: bounds, least and greatest value, and whether it violates.

    One aggregate for all columns; only its one row per run is unfolded.
    """
    checked = _ranged_columns(df, ranges)
    columns = list(dict.fromkeys(c for c, *_ in checked))

    def known(column: str) -> Column:
        return F.when(~F.isnan(column), F.col(column)).cast("double")

    wide = df.groupBy(run).agg(
        *[F.min(known(c)).alias(f"{c}_least") for c in columns],
        *[F.max(known(c)).alias(f"{c}_most") for c in columns],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(fragment).alias("fragment"),
            F.lit(low).alias("low"), F.lit(high).alias("high"),
            F.col(f"{c}_least").alias("least"), F.col(f"{c}_most").alias("most"),
        )
        for c, fragment, low, high in checked
    ])
    violated = (F.col("least") < F.col("low")) | (F.col("most") > F.col("high"))
    return wide.select(run, F.inline(rows)).withColumn(
        "violated", F.coalesce(violated, F.lit(False))
    )


def value_ranges(df: DataFrame, run: str = "run_id", ranges: Mapping = VALUE_RANGES) -> DataFrame:
    seen = value_extremes(df, run, ranges)
    beyond = F.when(F.col("least") < F.col("low"), F.col("least")).otherwise(F.col("most"))
    subject = F.concat_ws(":", F.col(run).cast("string"), F.col("column"), F.col("fragment"))
    return result(
        seen, "value_ranges", "run", subject, beyond,
        F.concat_ws("..", *[F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") for c in ("low", "high")]),
        ~F.col("violated"), "WARN",
    )


def range_summary(df: DataFrame, run: str = "run_id", ranges: Mapping = VALUE_RANGES) -> DataFrame:
    """Violations by the first fragment that the column's name contains."""
    fragments = list(ranges)
    first = reduce(
        lambda acc, f: acc.when(F.col("column").contains(f), f),
        fragments[1:],
        F.when(F.col("column").contains(fragments[0]), fragments[0]),
    )
    hits = value_extremes(df, run, ranges).where("violated")
    return hits.groupBy(first.alias("fragment")).agg(
        F.count_distinct(run).alias("n_runs"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def null_rates(
    df: DataFrame,
    run: str = "run_id",
    fragments: Sequence[str] = NULL_RATE_FRAGMENTS,
    limit: float = 0.01,
    present: DataFrame | None = None,
) -> DataFrame:
    """Mean over runs of each key column's null rate.

    ``present`` (run, column), from the footers of stored files, names the columns that a run has. On the stacked table
    a column that a run lacks looks like nulls; with ``present`` the run is left out of that column's mean.
    """
    columns = [c for c in df.columns if any(f in c for f in fragments)]

    def missing(column: str) -> Column:
        value = F.col(column)
        blank = value.isNull() | F.isnan(value) if column in _floats(df) else value.isNull()
        return blank.cast("double")

    per_run = df.groupBy(run).agg(*[F.avg(missing(c)).alias(c) for c in columns])
    if present is not None:
        had = present.where(F.col("column").isin(*columns)).groupBy(run).agg(F.collect_set("column").alias("_had"))
        per_run = per_run.join(had, run, "left").select(
            run, *[F.when(F.array_contains("_had", c), F.col(c)).alias(c) for c in columns]
        )
    wide = per_run.agg(*[F.avg(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rate")) for c in columns])
    rates = wide.select(F.inline(rows))
    return result(
        rates, "null_rates", "column", F.col("column"), F.col("rate"), f"<= {limit}",
        F.col("rate") <= limit, "WARN",
    )


def duplicate_timestamps(
    df: DataFrame,
    run: str,
    time: str,
    order: Sequence[Column | str],
    head: int = 200,
    limit: float = 0.95,
) -> DataFrame:
    """Share of repeated values among a run's first known times."""
    known = df.where(F.col(time).isNotNull()).select(run, time, *[c for c in order if c != time])
    runs = head_per_group(known, [run], order, head).groupBy(run).agg(
        F.count(time).alias("n"), F.count_distinct(time).alias("n_distinct")
    )
    rate = (F.col("n") - F.col("n_distinct")) / F.col("n")
    return result(
        runs, "duplicate_timestamps", "run", F.col(run), rate, f"<= {limit}", rate <= limit, "WARN"
    )


# --- run table ------------------------------------------------------------------------


def row_outliers_sigma(
    runs: DataFrame, tranche: str = "tranche", rows: str = "row_count"
) -> DataFrame:
    """Per tranche: runs farther than three population deviations from the median."""
    middle = exact_quantiles(runs, [tranche], rows, {"median": 0.5})
    spread = runs.groupBy(tranche).agg(F.stddev_pop(rows).alias("sigma"))
    limits = join_on(middle, spread, [tranche])
    far = F.count_if(F.abs(F.col(rows) - F.col("median")) > 3 * F.col("sigma"))
    counts = join_on(runs, limits, [tranche]).groupBy(tranche, "median").agg(
        far.alias("far"), F.min(rows).alias("least"), F.max(rows).alias("most")
    )
    expected = F.format_string("median=%.1f min=%d max=%d", "median", "least", "most")
    return result(
        counts, "row_outliers", "tranche", F.col(tranche), F.col("far"), expected,
        F.col("far") == 0, "WARN",
    )


def row_outliers_median(
    runs: DataFrame,
    tranche: str = "tranche",
    run: str = "run_id",
    rows: str = "row_count",
    low: float = 0.40,
    high: float = 2.50,
) -> DataFrame:
    """Runs far below or above their tranche's median."""
    middle = exact_quantiles(runs, [tranche], rows, {"median": 0.5})
    known = join_on(runs, middle, [tranche])
    n = F.col(rows)
    fine = n.between(F.col("median") * low, F.col("median") * high)
    return result(
        known, "row_outliers_median", F.col(tranche), F.col(run), n,
        f"{low} to {high} of median", fine, "WARN",
    )


def balance_session(df: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Share of on per session, within the tolerance around half."""
    known = class_balance(df, ["tranche", "session"]).where(F.col("pct_on").isNotNull())
    subject = F.concat_ws("/", "tranche", "session")
    return result(
        known, "balance_session", "session", subject, F.col("pct_on"), f"50 +- {tolerance}",
        F.abs(F.col("pct_on") - 50) <= tolerance, "WARN",
    )


def balance_tranche(df: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Gap between the shares of on and off per tranche; other labels count in the total."""
    counts = df.groupBy("tranche").agg(
        F.count_if(F.col("cipher_state") == "on").alias("n_on"),
        F.count_if(F.col("cipher_state") == "off").alias("n_off"),
        F.count("*").alias("n"),
    )
    gap = F.abs(F.col("n_on") * 100.0 / F.col("n") - F.col("n_off") * 100.0 / F.col("n"))
    return result(
        counts, "balance_tranche", "tranche", F.col("tranche"), gap, f"< {tolerance}",
        gap < tolerance, "WARN",
    )


def unknown_labels(ok: DataFrame) -> DataFrame:
    counts = ok.agg(F.count_if(F.col("cipher_state") == "unknown").alias("n"))
    return result(counts, "unknown_labels", "dataset", "all", F.col("n"), "0", F.col("n") == 0)


def label_mismatches(ok: DataFrame) -> DataFrame:
    """One row per run whose two labels disagree."""
    found = ok.where("label_mismatch")
    subject = F.concat_ws("/", "tranche", "session", "run_id")
    return result(
        found, "label_mismatch", "run", subject, F.lit(1), "labels agree", F.lit(False), "WARN"
    )


# --- files (see sources.files.footer_columns) -----------------------------------------


def boolean_columns(
    footers: DataFrame, allowed: Sequence[str] = ("label_mismatch",)
) -> DataFrame:
    """No measurement column is stored as boolean."""
    bad = F.count_if((F.col("type") == "bool") & ~F.col("column").isin(*allowed))
    files = footers.where(F.col("error").isNull()).groupBy("path").agg(bad.alias("bad"))
    return result(
        files, "boolean_columns", "file", F.col("path"), F.col("bad"), "0", F.col("bad") == 0
    )


def column_counts(footers: DataFrame) -> DataFrame:
    """Per tranche: fewest and most columns, and how many different counts occur."""
    files = footers.where(F.col("error").isNull()).groupBy("tranche", "path").agg(
        F.count("column").alias("n")
    )
    return files.groupBy("tranche").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count_distinct("n").alias("n_counts")
    )


def column_spread(footers: DataFrame) -> DataFrame:
    """Per tranche, how many different numbers of columns its files have; files of one tranche may differ, so no number is wrong."""
    counts = column_counts(footers)
    expected = F.format_string("%d to %d columns", "least", "most")
    return result(counts, "column_counts", "tranche", F.col("tranche"), F.col("n_counts"), expected, F.lit(True), "WARN")


def readable(footers: DataFrame) -> DataFrame:
    """Every file opens; the reason is kept for those that do not."""
    files = footers.groupBy("path").agg(F.max("error").alias("error"))
    return result(
        files, "readable", "file", F.col("path"), F.col("error").isNotNull().cast("int"),
        F.coalesce(F.col("error"), F.lit("opens")), F.col("error").isNull(),
    )


def distinct_schemas(footers: DataFrame) -> DataFrame:
    """Different sets of column names per tranche. A list holds one file's columns."""
    files = footers.where(F.col("error").isNull()).groupBy("tranche", "path").agg(
        F.array_join(F.array_sort(F.collect_list("column")), ",").alias("names")
    )
    return files.groupBy("tranche").agg(F.count_distinct("names").alias("n_schemas"))


def schema_uniform(footers: DataFrame, limit: int = 1) -> DataFrame:
    kinds = distinct_schemas(footers)
    return result(
        kinds, "schema_uniform", "tranche", F.col("tranche"), F.col("n_schemas"), f"<= {limit}",
        F.col("n_schemas") <= limit, "WARN",
    )


def files_present(missing: DataFrame, footers: DataFrame) -> DataFrame:
    """Counts of missing and of unreadable files."""
    broken = footers.where(F.col("error").isNotNull()).select("path").distinct()
    counts = missing.agg(F.count("*").alias("n")).withColumn("kind", F.lit("missing")).unionByName(
        broken.agg(F.count("*").alias("n")).withColumn("kind", F.lit("unreadable"))
    )
    return result(
        counts, "files_present", "dataset", F.col("kind"), F.col("n"), "0", F.col("n") == 0
    )


def dtype_conflicts(footers: DataFrame, fragment: str = "retransmission") -> DataFrame:
    """Files in which a column that should be floating point has another type."""
    wrong = F.col("column").contains(fragment) & ~F.col("type").isin("float", "double")
    return footers.where(wrong).select("path", "column", "type")


def mixed_types(footers: DataFrame) -> DataFrame:
    """Columns stored under more than one type across files."""
    return footers.where(F.col("error").isNull()).groupBy("column").agg(
        F.count_distinct("type").alias("n_types"), F.count("*").alias("n_files")
    ).where(F.col("n_types") > 1)


# --- declarative rules ----------------------------------------------------------------


def rule_label_set(runs: DataFrame) -> DataFrame:
    bad = runs.agg(F.count_if(~F.coalesce(F.col("cipher_state").isin("on", "off"), F.lit(False))).alias("n"))
    return result(bad, "DQ-01", "dataset", "cipher_state", F.col("n"), "on or off", F.col("n") == 0)


def rule_proportion_sum(
    df: DataFrame, run: str, column: str, values: Sequence[float], decimals: int = 1
) -> DataFrame:
    """Shares of the given readings add up to at most one."""
    parts = [F.avg(F.when(F.round(column, decimals) == v, 1.0).otherwise(0.0)) for v in values]
    sums = df.groupBy(run).agg(F.round(reduce(lambda a, b: a + b, parts), 9).alias("total"))
    return result(sums, "DQ-02", "run", F.col(run), F.col("total"), "<= 1", F.col("total") <= 1)


def rule_between(
    df: DataFrame,
    column: str,
    bounds: tuple[float, float] = RSRP_RANGE,
    run: str = "run_id",
    check_id: str = "DQ-03",
) -> DataFrame:
    """Readings of a run outside the bounds."""
    value = F.col(column)
    runs = df.groupBy(run).agg(F.count_if((value < bounds[0]) | (value > bounds[1])).alias("n"))
    return result(runs, check_id, "run", F.col(run), F.col("n"), between_text(*bounds), F.col("n") == 0)


def rule_row_count(
    df: DataFrame, run: str = "run_id", bounds: tuple[int, int] = RUN_ROWS_RANGE
) -> DataFrame:
    runs = df.groupBy(run).agg(F.count("*").alias("n"))
    return result(
        runs, "DQ-04", "run", F.col(run), F.col("n"), between_text(*bounds), F.col("n").between(*bounds)
    )


def rule_unit_interval(proportions: DataFrame, run: str = "run_id") -> DataFrame:
    """Proportions outside [0, 1] per measurand."""
    outside = ~F.col("value").between(0, 1)
    kinds = proportions.groupBy("measurand").agg(F.count_if(outside).alias("n"))
    return result(
        kinds, "DQ-05", "measurand", F.col("measurand"), F.col("n"), "[0, 1]", F.col("n") == 0
    )


def rule_quantile_order(long: DataFrame, run: str = "run_id") -> DataFrame:
    """Quantiles of a measurand do not fall; pairs out of order are counted per run.

    The points of one (run, measurand) are a handful, gathered into a short sorted array.
    """
    ladder = F.array_sort(F.collect_list(F.struct(F.col("feature_value").cast("double").alias("p"), "value")))
    steps = long.groupBy(run, "measurand").agg(ladder.alias("steps"))
    falls = F.size(F.filter(
        F.sequence(F.lit(0), F.size("steps") - 2),
        lambda i: F.get("steps", i)["value"] > F.get("steps", i + 1)["value"],
    ))
    counted = steps.withColumn("n", falls)
    return result(
        counted, "DQ-06", "run", F.concat_ws(":", F.col(run).cast("string"), "measurand"),
        F.col("n"), "non-decreasing", F.col("n") == 0,
    )


def rule_kpi_ranges(
    gold: DataFrame,
    ranges: Mapping[str, tuple[float, float]] = KPI_RANGES,
    run: str = "run_id",
    check_id: str = "kpi_ranges",
) -> DataFrame:
    """Each KPI of a run lies in its expected range; unknown values pass."""
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("kpi"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"),
            F.col(k).alias("value"), F.lit(between_text(low, high)).alias("range"),
        )
        for k, (low, high) in ranges.items()
    ])
    long = gold.select(run, F.inline(rows))
    fine = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True))
    return result(
        long, check_id, "run", F.concat_ws(":", F.col(run).cast("string"), "kpi"), F.col("value"),
        F.col("range"), fine,
    )


def rule_ratio_bounds(gold: DataFrame, run: str = "run_id") -> DataFrame:
    return rule_kpi_ranges(gold, {"harq_efficiency": (0.0, 1.0)}, run, "DQ-07")


def rule_completeness(manifest: DataFrame, incomplete: DataFrame) -> DataFrame:
    """No manifest run lacks a passing entry in the pipeline log."""
    counts = incomplete.agg(F.count("*").alias("n"))
    expected = F.concat(manifest.agg(F.count("*").cast("string")).scalar(), F.lit(" runs passed"))
    return result(counts, "DQ-08", "dataset", "runs", F.col("n"), expected, F.col("n") == 0)


# --- the suite ------------------------------------------------------------------------


def suite(
    df: DataFrame,
    run: str = "run_id",
    ranges: Mapping[str, tuple[float, float]] = VALUE_RANGES,
    fragments: Sequence[str] = NULL_RATE_FRAGMENTS,
    limit: float = 0.01,
    present: DataFrame | None = None,
    time: str | None = None,
    order: Sequence[Column | str] = ("ordinal",),
    footers: DataFrame | None = None,
) -> DataFrame:
    """All checks of measurement rows, and of the runs they form, from one aggregate over the rows.

    Labels, ranges, null rates, rows per tranche and balance per session read one stored row per run. The results are
    those of the single checks. ``df`` carries the identity of the runs. With ``time``, the first times of each run in its
    ``order`` are checked too; with ``footers`` of the stored files also their boolean columns and their numbers of columns.
    """
    measured = list(dict.fromkeys(
        [c for c, *_ in _ranged_columns(df, ranges)] + [c for c in df.columns if any(f in c for f in fragments)]
    ))
    floats = set(_floats(df))

    def known(column: str) -> Column:
        return F.when(~F.isnan(column), F.col(column)) if column in floats else F.col(column)

    bad = F.count_if(F.col("cipher_state").isNull() | ~F.col("cipher_state").isin("on", "off"))
    runs = materialize(df.groupBy(run).agg(
        *[F.min(c).alias(c) for c in ("cipher_state", "tranche", "session")],
        F.count("*").alias("row_count"), bad.alias("_bad"),
        *[F.struct(F.min(known(c)).alias("least"), F.max(known(c)).alias("most"), F.count(known(c)).alias("n")).alias(c) for c in measured],
    ))
    ends = runs.select(run, *[F.col(f"{c}.least").alias(c) for c in measured]).unionByName(
        runs.select(run, *[F.col(f"{c}.most").alias(c) for c in measured])
    )  # the checks of single rows ask only for the ends of a run's values
    labels = result(runs, "label_valid", "run", F.col(run), F.col("_bad"), "on or off", F.col("_bad") == 0)
    rates = runs.select(run, *[(1 - F.col(f"{c}.n") / F.col("row_count")).alias(c) for c in measured if any(f in c for f in fragments)])
    if present is not None:
        had = present.groupBy(run).agg(F.collect_set("column").alias("_had"))
        rates = rates.join(had, run, "left").select(run, *[F.when(F.array_contains("_had", c), F.col(c)).alias(c) for c in rates.columns if c != run])
    names = [c for c in rates.columns if c != run]
    means = rates.agg(*[F.avg(c).alias(c) for c in names]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rate")) for c in names]))
    )
    nulls = result(means, "null_rates", "column", F.col("column"), F.col("rate"), f"<= {limit}", F.col("rate") <= limit, "WARN")
    parts = [labels, value_ranges(ends, run, ranges), nulls, row_outliers_sigma(runs), balance_session(runs)]
    if time is not None:
        parts.append(duplicate_timestamps(df, run, time, order))
    if footers is not None:
        parts += [boolean_columns(footers), column_spread(footers)]
    return combine(parts)


# --- verdicts -------------------------------------------------------------------------


def verdict(results: DataFrame, blocking: Sequence[str] = BLOCKING) -> DataFrame:
    """CLEAN when no blocking check has a finding; which checks block is a parameter."""
    counted = F.col("check_id").isin(*blocking) & (F.col("status") != "PASS")
    return results.agg(F.count_if(counted).alias("n_issues")).withColumn(
        "verdict", F.when(F.col("n_issues") == 0, "CLEAN").otherwise("REVIEW")
    )


def validation_verdict(results: DataFrame) -> DataFrame:
    """PASS when nothing failed; warnings do not count."""
    failed = F.count_if(F.col("status") == "FAIL")
    return results.agg(failed.alias("n_issues")).withColumn(
        "verdict", F.when(F.col("n_issues") == 0, "PASS").otherwise("FAIL")
    )


def sample_findings(results: DataFrame, k: int = 5) -> DataFrame:
    """First findings of each check, by subject."""
    return head_per_group(
        results.where(F.col("status") != "PASS"), ["check_id"], ["subject"], k
    ).select("check_id", "subject", "observed", "place")


def worst_null_columns(results: DataFrame, k: int = 10) -> DataFrame:
    high = results.where((F.col("check_id") == "null_rates") & (F.col("status") != "PASS"))
    return high.orderBy(F.desc("observed"), "subject").limit(k).select("subject", "observed")
