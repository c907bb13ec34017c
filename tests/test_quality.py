import pytest
from pyspark.sql import functions as F

from runlens.operators import features, gold, manifest, quality


def status(df, key="subject"):
    return {r[key]: r.status for r in df.collect()}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_result_schema(spark):
    df = frame(spark, [("r", "on")], "run_id string, cipher_state string")
    out = quality.label_valid(df)
    assert tuple(out.columns) == quality.RESULT
    assert dict(out.dtypes)["observed"] == "double"


def test_labels_of_all_rows(spark):
    rows = [("a", "on"), ("a", "on"), ("b", "on"), ("b", None), ("c", "unknown")]
    out = quality.label_valid(frame(spark, rows, "run_id string, cipher_state string"))
    assert status(out) == {"a": "PASS", "b": "FAIL", "c": "FAIL"}


def test_ranges_ignore_missing_values(spark):
    rows = [("a", 0.5, 5), ("a", float("nan"), 5), ("b", None, 5), ("c", 1.01, 5), ("d", -0.1, 5)]
    df = frame(spark, rows, "run_id string, x__dl_sch_bler double, x__lost_pdus int")
    assert status(quality.value_ranges(df)) == {
        "a:x__dl_sch_bler:dl_sch_bler": "PASS", "b:x__dl_sch_bler:dl_sch_bler": "PASS",
        "c:x__dl_sch_bler:dl_sch_bler": "WARN", "d:x__dl_sch_bler:dl_sch_bler": "WARN",
    }
    summary = quality.range_summary(df).collect()
    assert [(r.fragment, r.n_runs, r.least, r.most) for r in summary] == [("dl_sch_bler", 2, -0.1, 1.01)]


def test_null_rates_weigh_runs_equally(spark):
    rows = [("a", None)] + [("b", 1.0)] * 99
    out = quality.null_rates(frame(spark, rows, "run_id string, bler double")).first()
    assert (out.observed, out.status) == (0.5, "WARN")


@pytest.mark.parametrize("distinct, expected", [(11, "PASS"), (10, "PASS"), (9, "WARN")])
def test_duplicate_timestamps_at_the_limit(spark, distinct, expected):
    rows = [("r", i, float(min(i, distinct - 1))) for i in range(200)]
    rows += [("r", 200 + i, 1000.0 + i) for i in range(50)] + [("r", -1, None)]
    out = quality.duplicate_timestamps(frame(spark, rows, "run string, pos int, t double"), "run", "t", ["pos"])
    assert out.first().status == expected


def test_sigma_uses_the_population_deviation(spark):
    rows = [("A", str(i), 100) for i in range(10)] + [("A", "x", 200)]
    out = quality.row_outliers_sigma(frame(spark, rows, "tranche string, run_id string, row_count int")).first()
    assert (out.observed, out.status) == (1.0, "WARN")


def test_median_bounds_are_inclusive(spark):
    rows = [("A", "m", 100), ("A", "n", 100), ("A", "lo", 40), ("A", "lower", 39), ("A", "hi", 250), ("A", "higher", 251)]
    out = status(quality.row_outliers_median(frame(spark, rows, "tranche string, run_id string, row_count int")))
    assert out == {"m": "PASS", "n": "PASS", "lo": "PASS", "lower": "WARN", "hi": "PASS", "higher": "WARN"}


def test_balance_limits(spark):
    rows = [("A", "S1", "on")] * 13 + [("A", "S1", "off")] * 7 + [("A", "S2", "on")] * 2 + [("A", "S2", "off")]
    rows += [("B", "S1", "unknown")]
    df = frame(spark, rows, "tranche string, session string, cipher_state string")
    assert status(quality.balance_session(df)) == {"A/S1": "PASS", "A/S2": "WARN"}
    assert status(quality.balance_tranche(df)) == {"A": "WARN", "B": "PASS"}


def test_quantile_ladder(spark):
    rows = [("r", "m", str(p), v) for p, v in ((0.05, 1.0), (0.5, 3.0), (0.25, 2.0), (0.95, 2.5))]
    rows += [("s", "m", "0.5", 1.0)]
    df = frame(spark, rows, "run_id string, measurand string, feature_value string, value double")
    assert status(quality.rule_quantile_order(df)) == {"r:m": "FAIL", "s:m": "PASS"}


def test_proportions_add_up(spark):
    rows = [("r", float(i % 3)) for i in range(30)] + [("r", None)]
    long = features.feature_proportions(frame(spark, rows, "run_id string, v double"), "run_id", {"v": 0})
    assert long.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    assert status(quality.rule_unit_interval(long)) == {"v": "PASS"}


def test_completeness(spark):
    runs = frame(spark, [("a",), ("b",)], "run_id string")
    log = frame(spark, [("a", "pass"), ("b", "fail"), ("b", "fail")], "run_id string, status string")
    out = quality.rule_completeness(runs, manifest.incomplete_runs(runs, log)).first()
    assert (out.observed, out.expected, out.status) == (1.0, "2 runs passed", "FAIL")


def test_verdicts(spark):
    schema = "check_id string, subject string, observed double, status string"
    warn = frame(spark, [("balance_session", "s", 1.0, "WARN"), ("value_ranges", "v", 1.0, "WARN")], schema)
    assert quality.verdict(warn).first().n_issues == 1
    assert quality.validation_verdict(warn).first().verdict == "PASS"
    fine = frame(spark, [("label_valid", "s", 0.0, "PASS")], schema)
    assert quality.verdict(fine).first().verdict == "CLEAN"


def test_zero_denominators_give_null(spark):
    names = ["retx_0_mean", "retx_total_mean", "bler_q95", "bler_q05", "dl_throughput_mean", "mcs_mean",
             "pdcp_lost_pdus_mean", "pdcp_sdu_tput_mean", "mac_tx_agg_tput_mean"]
    row = [1.0, 0.0, 0.5, 0.25, 1.0, 0.0, 0.0, 0.0, 0.0]
    df = frame(spark, [row], ", ".join(f"{n} double" for n in names))
    found = df.select(*[build().alias(k) for k, build in gold.KPIS.items()]).first()
    assert found.asDict() == {
        "harq_efficiency": None, "bler_spread": 0.25, "spectral_efficiency": None,
        "pdcp_discard_rate": None, "dl_ul_asymmetry": None,
    }


def test_absent_columns_are_no_nulls(spark):
    rows = [("a", 1.0, 5.0), ("a", None, 5.0), ("b", None, 5.0), ("b", None, None)]  # b's file has no bler
    df = spark.createDataFrame(rows, "run_id string, bler double, mcs double")
    present = spark.createDataFrame([("a", "bler"), ("a", "mcs"), ("b", "mcs")], "run_id string, column string")
    found = {r.subject: r.observed for r in quality.null_rates(df, fragments=["bler", "mcs"], present=present).collect()}
    assert found == {"bler": 0.5, "mcs": 0.25}
    found = {r.subject: r.observed for r in quality.null_rates(df, fragments=["bler", "mcs"]).collect()}
    assert found == {"bler": 0.75, "mcs": 0.25}


def test_fractional_bounds(spark):
    df = spark.createDataFrame([("a", 0.95)], "run_id string, bler double")
    row = quality.value_ranges(df, ranges={"bler": (0.1, 0.9)}).first()
    assert (row.expected, row.status) == ("0.1..0.9", "WARN")
    assert quality.value_ranges(df, ranges={"bler": (0, 1)}).first().expected == "0..1"
