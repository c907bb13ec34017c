"""Data-quality checks on measurement rows, runs and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import features, footers, manifest, quality
from runlens.plans.queries.measurements import (
    DISCRETE, FEATURE_QUANTILES_SQL, GOLD_SQL, PROPORTIONS_SQL, gold_of,
)
from runlens.plans.registry import Tables, query, rounded
from runlens.plans.views import BRONZE, MANIFEST, NATIVE, PIPELINE_LOG, RUNS, View
from runlens.session import scratch_path
from runlens.sources import files, tables

MANIFEST_SQL, RUNS_SQL, NATIVE_SQL = MANIFEST.sql(), RUNS.sql(), NATIVE.sql()
OK_SQL = f"(select * from {MANIFEST_SQL} where outcome = 'ok')"

# Measurement rows in which labels, ranges and nulls go wrong in places.
FAULTY = View("lineitem", [
    "l_suppkey as run_id",
    "case when l_quantity = 50 and l_linenumber = 7 and l_tax > 0.07 then 'maybe'"
    " when l_tax = 0.08 and l_quantity = 1 and l_linenumber = 1 then null"
    " when l_suppkey % 2 = 0 then 'on' else 'off' end as cipher_state",
    "l_discount * 10.05e0 as carrier__dl_sch_bler", "l_quantity * 0.57e0 as carrier__mean_mcs",
    "nullif(l_extendedprice / 1700 - 1, -0.5) as carrier__snr__db_",
    "l_extendedprice * 10 as rx__sdu_throughput_kbps_", "nullif(l_tax, 0.03) as rx__lost_pdus",
    "l_linenumber as rx__bad_pdus",
])
FAULTY_SQL = FAULTY.sql()
RANGED = (
    ("carrier__dl_sch_bler", "dl_sch_bler", 0, 1), ("carrier__snr__db_", "snr", -30, 60),
    ("carrier__mean_mcs", "mean_mcs", 0, 28), ("rx__lost_pdus", "lost_pdu", 0, 100000),
    ("rx__sdu_throughput_kbps_", "sdu_throughput", 0, 1000000),
)
EXTREMES_SQL = "(" + " union all ".join(
    f"select run_id, '{c}' as col, '{f}' as fragment, {lo} as lo, {hi} as hi, min({c}) as least, max({c}) as most"
    f" from {FAULTY_SQL} group by 1" for c, f, lo, hi in RANGED
) + ")"


def result_sql(check, scope, subject, observed, expected, passed, source, severity="FAIL") -> str:
    return f"""select '{check}' as check_id, {scope} as scope, cast({subject} as varchar) as subject,
     cast({observed} as double) as observed, {expected} as expected,
     case when {passed} then 'PASS' else '{severity}' end as status, '{severity}' as severity from {source}"""


LABEL_VALID_SQL = result_sql(
    "label_valid", "'run'", "run_id", "bad", "'on or off'", "bad = 0",
    f"(select run_id, count(*) filter (where cipher_state is null or cipher_state not in ('on', 'off')) as bad from {FAULTY_SQL} group by 1)",
)


@query("dq_label_valid", LABEL_VALID_SQL)
def dq_label_valid(load: Tables):
    return quality.label_valid(load(FAULTY))


VALUE_RANGES_SQL = result_sql(
    "value_ranges", "'run'", "concat(run_id, ':', col, ':', fragment)",
    "case when least < lo then least else most end", "concat(lo, '..', hi)",
    "not coalesce(least < lo or most > hi, false)", EXTREMES_SQL, "WARN",
)


@query("dq_value_ranges", VALUE_RANGES_SQL)
def dq_value_ranges(load: Tables):
    return quality.value_ranges(load(FAULTY))


@query("dq_range_summary", f"""select fragment, count(distinct run_id) as n_runs, min(least) as least, max(most) as most
 from {EXTREMES_SQL} where least < lo or most > hi group by 1""")
def dq_range_summary(load: Tables):
    return quality.range_summary(load(FAULTY))


SIGMA_SQL = result_sql(
    "row_outliers", "'tranche'", "tranche", "far",
    "concat('median=', printf('%.1f', med), ' min=', least, ' max=', most)", "far = 0",
    f"""(select tranche, med, min(row_count) as least, max(row_count) as most,
     count(*) filter (where abs(row_count - med) > 3 * sd) as far from {RUNS_SQL} join
     (select tranche, median(row_count) as med, stddev_pop(row_count) as sd from {RUNS_SQL} group by 1) using (tranche)
     group by 1, 2)""", "WARN",
)


@query("dq_row_outliers", SIGMA_SQL)
def dq_row_outliers(load: Tables):
    return quality.row_outliers_sigma(load(RUNS))


BALANCE_SQL = result_sql(
    "balance_session", "'session'", "concat(tranche, '/', session)", "pct", "'50 +- 15.0'",
    "abs(pct - 50) <= 15",
    f"""(select tranche, session, count(*) filter (where cipher_state = 'on') * 100.0e0 / count(*) as pct
     from {MANIFEST_SQL} where cipher_state in ('on', 'off') group by 1, 2)""", "WARN",
)


@query("dq_balance_session", BALANCE_SQL)
def dq_balance_session(load: Tables):
    return quality.balance_session(load(MANIFEST))


NULL_COLUMNS = ("carrier__dl_sch_bler", "carrier__mean_mcs", "carrier__snr__db_",
                "rx__sdu_throughput_kbps_", "rx__lost_pdus")
NULL_RATES_SQL = "select check_id, scope, subject, round(observed, 9) as observed, expected, status, severity from (" + \
    result_sql("null_rates", "'column'", "col", "rate", "'<= 0.01'", "rate <= 0.01", "(" + " union all ".join(
        f"select '{c}' as col, avg(r) as rate from (select run_id, avg(case when {c} is null then 1e0 else 0e0 end) as r"
        f" from {FAULTY_SQL} group by 1)" for c in NULL_COLUMNS) + ")", "WARN") + ")"


@query("dq_null_rates", NULL_RATES_SQL)
def dq_null_rates(load: Tables):
    return rounded(quality.null_rates(load(FAULTY)), 9, "observed")


WHOLE = View("lineitem", [
    *FAULTY.columns, "concat('T', cast(l_suppkey % 3 as varchar(2))) as tranche",
    "concat('S', cast(l_suppkey % 5 as varchar(2))) as session",
])
WHOLE_RUNS_SQL = f"""(select run_id, min(cipher_state) as cipher_state, min(tranche) as tranche, min(session) as session,
 count(*) as row_count from {WHOLE.sql()} group by 1)"""
SUITE_SQL = "select check_id, scope, subject, round(observed, 9) as observed, expected, status, severity from (" + " union all ".join(
    f"select check_id, scope, subject, observed, expected, status, severity from ({part})" for part in (
        LABEL_VALID_SQL, VALUE_RANGES_SQL, NULL_RATES_SQL,
        SIGMA_SQL.replace(RUNS_SQL, WHOLE_RUNS_SQL), BALANCE_SQL.replace(MANIFEST_SQL, WHOLE_RUNS_SQL),
    )
) + ")"


@query("dq_suite", SUITE_SQL)
def dq_suite(load: Tables):
    """The checks of measurement rows in one pass."""
    return rounded(quality.suite(load(WHOLE)), 9, "observed")


# The faulty rows stored by run, with NaN in one column of one run in ten: only that run's footers cannot tell.
STORED_FAULTY = View("lineitem", [
    "l_suppkey as run_no", "'Tranche_A' as tranche", "concat('Session_', cast(l_suppkey % 3 as varchar(3))) as session",
    "cast(l_suppkey as varchar(12)) as run_id", "l_orderkey * 10 + l_linenumber as ordinal",
    *[c for c in FAULTY.columns if "carrier__" in c and "snr" not in c], *[c for c in FAULTY.columns if "rx__" in c],
    "case when l_suppkey % 10 = 3 and l_linenumber = 1 then cast('NaN' as double) else nullif(l_extendedprice / 1700 - 1, -0.5) end as carrier__snr__db_",
])
UNKNOWN_SQL = f"(select * replace (case when isnan(carrier__snr__db_) then null else carrier__snr__db_ end as carrier__snr__db_) from {STORED_FAULTY.sql()})"


def _stored_faulty(load: Tables) -> str:
    path = scratch_path(load.spark, "faulty")
    tables.write_bronze(load(STORED_FAULTY).drop("run_no"), path, by_run=True)
    return path


@query("dq_footer_checks", f"select check_id, scope, subject, round(observed, 9) as observed, expected, status, severity from ("
       f"select * from ({VALUE_RANGES_SQL.replace(FAULTY_SQL, UNKNOWN_SQL)}) union all select * from ({NULL_RATES_SQL.replace(FAULTY_SQL, UNKNOWN_SQL)}))")
def dq_footer_checks(load: Tables):
    """Ranges and null rates from footers; a few files are read for their NaN."""
    checks, _, _ = footers.footer_checks(load.spark, _stored_faulty(load), _floating(load))
    return rounded(checks, 9, "observed")


def _floating(load: Tables) -> list[str]:
    return [c for c, kind in load(STORED_FAULTY).dtypes if kind == "double"]


@query("dq_footer_scans", f"""select cast(count(distinct run_no) filter (where run_no % 10 = 3 and isnan(carrier__snr__db_)) as bigint) as n_runs_read,
 cast(count(distinct run_no) as bigint) as n_runs, true as few_files, fragment, x.n_runs as n_violating, x.least, x.most from {STORED_FAULTY.sql()} s,
 (select fragment, count(distinct run_id) as n_runs, min(least) as least, max(most) as most from {EXTREMES_SQL.replace(FAULTY_SQL, UNKNOWN_SQL)}
  where least < lo or most > hi group by 1) x group by all""")
def dq_footer_scans(load: Tables):
    """Which runs the checks had to read, and the summary of violated ranges."""
    _, summary, found = footers.footer_checks(load.spark, _stored_faulty(load), _floating(load))
    rows = load(STORED_FAULTY)
    n_odd = F.count_distinct(F.when(F.isnan("carrier__snr__db_"), F.col("run_no")))
    return summary.select(
        rows.select(n_odd).scalar().alias("n_runs_read"), rows.select(F.count_distinct("run_no")).scalar().alias("n_runs"),
        ((F.lit(found.n_read) >= rows.select(n_odd).scalar()) & F.lit(found.n_read * 2 < found.n_files)).alias("few_files"),
        "fragment", F.col("n_runs").alias("n_violating"), "least", "most",
    )


DUPLICATES_SQL = result_sql(
    "duplicate_timestamps", "'run'", "run_id", "rate", "'<= 0.95'", "rate <= 0.95",
    """(select l_suppkey as run_id, (count(*) - count(distinct day)) / count(*) as rate from (
     select l_suppkey, l_linenumber as day, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey,
      l_linenumber, l_partkey) as r from lineitem where l_linenumber is not null) where r <= 200 group by 1)""", "WARN",
)


@query("dq_duplicate_timestamps", DUPLICATES_SQL)
def dq_duplicate_timestamps(load: Tables):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    rows = load("lineitem").select(F.col("l_suppkey").alias("run_id"), *order)
    return quality.duplicate_timestamps(rows, "run_id", "l_linenumber", order)



@query("dq_verdict", f"""select count(*) as n_issues,
 case when count(*) = 0 then 'CLEAN' else 'REVIEW' end as verdict
 from ({LABEL_VALID_SQL} union all {VALUE_RANGES_SQL} union all {BALANCE_SQL} union all {DUPLICATES_SQL})
 where status <> 'PASS' and check_id in ('label_valid', 'balance_session', 'duplicate_timestamps')""")
def dq_verdict(load: Tables):
    checks = [dq_label_valid(load), dq_value_ranges(load), dq_balance_session(load),
              dq_duplicate_timestamps(load)]
    return quality.verdict(quality.combine(checks))


@query("sample_violations", f"""select check_id, subject, observed, cast(place as integer) as place from (
 select *, row_number() over (partition by check_id order by subject) as place from
 ({LABEL_VALID_SQL} union all {VALUE_RANGES_SQL} union all {BALANCE_SQL}) where status <> 'PASS') where place <= 5""")
def sample_violations(load: Tables):
    checks = [dq_label_valid(load), dq_value_ranges(load), dq_balance_session(load)]
    return quality.sample_findings(quality.combine(checks), 5)


UNKNOWN_SQL = result_sql(
    "unknown_labels", "'dataset'", "'all'", "n", "'0'", "n = 0",
    f"(select count(*) filter (where cipher_state = 'unknown') as n from {OK_SQL})",
)


@query("val_unknown_labels", UNKNOWN_SQL)
def val_unknown_labels(load: Tables):
    return quality.unknown_labels(manifest.ok_runs(load(MANIFEST)))


TRANCHE_SQL = result_sql(
    "balance_tranche", "'tranche'", "tranche", "gap", "'< 10.0'", "gap < 10",
    f"""(select tranche, abs(count(*) filter (where cipher_state = 'on') * 100.0e0 / count(*)
     - count(*) filter (where cipher_state = 'off') * 100.0e0 / count(*)) as gap from {OK_SQL} group by 1)""", "WARN",
)


@query("val_balance_tranche", TRANCHE_SQL)
def val_balance_tranche(load: Tables):
    return quality.balance_tranche(manifest.ok_runs(load(MANIFEST)))


MISMATCH_SQL = result_sql(
    "label_mismatch", "'run'", "concat(tranche, '/', session, '/', run_id)", "1", "'labels agree'", "false",
    f"{OK_SQL} where label_mismatch", "WARN",
)


@query("val_label_mismatch", MISMATCH_SQL)
def val_label_mismatch(load: Tables):
    return quality.label_mismatches(manifest.ok_runs(load(MANIFEST)))


# Row counts spread widely enough to have outliers: only large purchases count.
LARGE = View("events", [
    "user_id as run_id", "concat('Tranche_', substr('ABC', cast(user_id % 3 as int) + 1, 1)) as tranche",
    "count(case when value > 25 then 1 end) as row_count",
], group=2)
LARGE_SQL = LARGE.sql()


@query("val_row_outliers", result_sql(
    "row_outliers_median", "tranche", "run_id", "row_count", "'0.4 to 2.5 of median'",
    "row_count between med * 0.4 and med * 2.5",
    f"""(select * from {LARGE_SQL} join (select tranche, median(row_count) as med from {LARGE_SQL} group by 1)
     using (tranche))""", "WARN"))
def val_row_outliers(load: Tables):
    return quality.row_outliers_median(load(LARGE))


@query("val_verdict", f"""select count(*) as n_issues, case when count(*) = 0 then 'PASS' else 'FAIL' end as verdict
 from ({UNKNOWN_SQL} union all {TRANCHE_SQL} union all {MISMATCH_SQL}) where status = 'FAIL'""")
def val_verdict(load: Tables):
    checks = [val_unknown_labels(load), val_balance_tranche(load), val_label_mismatch(load)]
    return quality.validation_verdict(quality.combine(checks))


@query("rule_label_set", result_sql(
    "DQ-01", "'dataset'", "'cipher_state'", "n", "'on or off'", "n = 0",
    f"(select count(*) filter (where coalesce(cipher_state not in ('on', 'off'), true)) as n from {FAULTY_SQL})"))
def rule_label_set(load: Tables):
    return quality.rule_label_set(load(FAULTY))


@query("rule_proportion_sum", result_sql(
    "DQ-02", "'run'", "run_id", "total", "'<= 1'", "total <= 1",
    f"""(select run_id, round(count(*) filter (where round(rsrq, 1) in (-10.4, -10.5, -10.3)) / count(*), 9) as total
     from {BRONZE.sql()} group by 1)"""))
def rule_proportion_sum(load: Tables):
    return quality.rule_proportion_sum(load(BRONZE), "run_id", "rsrq", [-10.4, -10.5, -10.3])


RSRP = "l1_powers__real_rsrp__pcc__dbm_"


@query("rule_between", result_sql(
    "DQ-03", "'run'", "run_id", "n", "'[-72.0, -65.3]'", "n = 0",
    f"(select run_id, count(*) filter (where {RSRP} < -72.0 or {RSRP} > -65.3) as n from {NATIVE_SQL} group by 1)"))
def rule_between(load: Tables):
    return quality.rule_between(load(NATIVE), RSRP)


@query("rule_row_count", result_sql(
    "DQ-04", "'run'", "run_id", "n", "'[580, 20000]'", "n between 580 and 20000",
    f"(select run_id, count(*) as n from {BRONZE.sql()} group by 1)"))
def rule_row_count(load: Tables):
    return quality.rule_row_count(load(BRONZE), "run_id", (580, 20000))


@query("rule_unit_interval", result_sql(
    "DQ-05", "'measurand'", "measurand", "n", "'[0, 1]'", "n = 0",
    f"(select measurand, count(*) filter (where value < 0 or value > 1) as n from ({PROPORTIONS_SQL}) group by 1)"))
def rule_unit_interval(load: Tables):
    return quality.rule_unit_interval(features.feature_proportions(load(BRONZE), "run_id", DISCRETE))


@query("rule_quantile_order", result_sql(
    "DQ-06", "'run'", "concat(run_id, ':', measurand)", "n", "'non-decreasing'", "n = 0",
    f"""(select run_id, measurand, count(*) filter (where value < before) as n from (select *, lag(value) over
     (partition by run_id, measurand order by cast(feature_value as double)) as before from ({FEATURE_QUANTILES_SQL}))
     group by 1, 2)"""))
def rule_quantile_order(load: Tables):
    return quality.rule_quantile_order(
        features.feature_quantiles(load(BRONZE), "run_id", ["dl_tput", "mcs"])
    )


@query("rule_ratio_bounds", result_sql(
    "DQ-07", "'run'", "concat(run_id, ':harq_efficiency')", "harq_efficiency", "'[0.0, 1.0]'",
    "coalesce(harq_efficiency between 0 and 1, true)", GOLD_SQL))
def rule_ratio_bounds(load: Tables):
    return quality.rule_ratio_bounds(gold_of(load))


@query("rule_completeness", result_sql(
    "DQ-08", "'dataset'", "'runs'", "n", "concat(total, ' runs passed')", "n = 0",
    f"""(select count(*) filter (where run_id not in (select run_id from {PIPELINE_LOG.sql()} where status = 'pass')) as n,
     count(*) as total from {MANIFEST_SQL})"""))
def rule_completeness(load: Tables):
    runs = load(MANIFEST)
    return quality.rule_completeness(runs, manifest.incomplete_runs(runs, load(PIPELINE_LOG)))


@query("rule_kpi_ranges", " union all ".join(
    result_sql("kpi_ranges", "'run'", f"concat(run_id, ':{k}')", k, f"'[{lo}, {hi}]'",
               f"coalesce({k} between {lo} and {hi}, true)", GOLD_SQL)
    for k, (lo, hi) in quality.KPI_RANGES.items()))
def rule_kpi_ranges(load: Tables):
    return quality.rule_kpi_ranges(gold_of(load))
