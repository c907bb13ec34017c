"""Aggregates over measurement rows: Silver, its families, feature tables, KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import stats
from runlens.operators import features, gold, silver, silver_states
from runlens.operators.features import Benchmark
from runlens.plans.registry import Tables, query, rounded
from runlens.plans.views import BRONZE, NATIVE
from runlens.session import scratch_path, stored

BRONZE_SQL, NATIVE_SQL = BRONZE.sql(), NATIVE.sql()


def silver_sql(families=None, nudge: float = 0.0) -> str:
    """The run feature table as SQL, spelled from the list of features. ``nudge``: see ``silver_states.merged``."""
    columns = ["run_id", "cipher_state", "tranche", "session",
               "min(measurement_ts) as measurement_ts", "count(*) as row_count"]
    for f in silver.features_of(families):
        value = " + ".join(f.sources)
        for stat in f.stats:
            digits = f.decimals
            if stat == "mean":
                text = f"avg({value})"
            elif stat == "stddev":
                text = f"stddev_samp({value})"
            elif stat == "nonzero_rate":
                text, digits = f"count(*) filter (where {value} > 0) / count(*)", 6
            else:
                text = f"quantile_disc({value}, {int(stat[1:]) / 100})"
            if nudge and stat in ("mean", "stddev"):
                text += f" + {nudge * 10.0**-digits!r}"
            columns.append(f"round({text}, {digits}) as {f.stem}_{stat}")
    return f"select {', '.join(columns)} from {NATIVE_SQL} group by 1, 2, 3, 4"


SILVER_SQL = f"({silver_sql()})"


@query("silver_run_features", silver_sql())
def silver_run_features(load: Tables):
    return silver.run_features(silver.gathered(load(NATIVE)))


@query("silver_identity", silver_sql([]))
def silver_identity(load: Tables):
    return silver.run_features(load(NATIVE), [])


@query("silver_incremental", silver_sql(nudge=0.01))
def silver_incremental(load: Tables):
    """Silver after late files of half of the runs, from stored states: the second refresh reads the late files only."""
    bronze, states = scratch_path(load.spark, "bronze"), scratch_path(load.spark, "states")
    rows = load(NATIVE).withColumn("late", (F.col("run_id") % 2 == 0) & (F.col("l1_dl_carrier__retransmission_1") > 2))
    keys = ["tranche", "session", "run_id"]
    for late in (False, True):
        part = rows.where(F.col("late") == late).drop("late")
        part.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append").partitionBy("tranche", "session").parquet(bronze)
        if not late:
            silver_states.update(load.spark, bronze, states, load(NATIVE).schema)
    found, _ = silver_states.refresh(load.spark, bronze, states, load(NATIVE).schema, nudge=0.01)
    return found


def _family(name: str) -> None:
    @query(f"silver_{name}", silver_sql([name]))
    def build(load: Tables):
        return silver.run_features(silver.gathered(load(NATIVE)), [name])


for _name in silver.FAMILIES:
    _family(_name)


@query("silver_projection", silver_sql() + " order by tranche, session, run_id")
def silver_projection(load: Tables):
    """Silver is stored before it is ordered: Spark looks for the bounds of an order first, and would sketch every run twice."""
    return silver.ordered(stored(silver.run_features(silver.gathered(load(NATIVE))), "silver"))


@query("agg_approx_quantiles", f"""select run_id, {', '.join(
    f'quantile_disc(dl_tput, {p}) as q{int(p * 100):02d}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))}
 from {BRONZE_SQL} group by 1""")
def agg_approx_quantiles(load: Tables):
    points = (0.05, 0.25, 0.5, 0.75, 0.95)
    sketches = load(BRONZE).groupBy("run_id").agg(stats.quantiles(F.col("dl_tput"), points).alias("q"))
    return sketches.select("run_id", *[F.col("q")[i].alias(f"q{int(p * 100):02d}") for i, p in enumerate(points)])


@query("agg_nonzero_rate", f"""select run_id,
 count(*) filter (where lost_pdus > 0) / count(*) as rate from {BRONZE_SQL} group by 1""")
def agg_nonzero_rate(load: Tables):
    return load(BRONZE).groupBy("run_id").agg(stats.share(F.col("lost_pdus") > 0).alias("rate"))


@query("agg_mean_stddev", f"""select run_id, round(avg(lost_pdus), 8) as mean,
 round(stddev_samp(lost_pdus), 8) as stddev from {BRONZE_SQL} group by 1""")
def agg_mean_stddev(load: Tables):
    grouped = load(BRONZE).groupBy("run_id").agg(
        F.avg("lost_pdus").alias("mean"), F.stddev_samp("lost_pdus").alias("stddev")
    )
    return rounded(grouped, 8, "mean", "stddev")


@query("agg_row_sum_mean", f"""select run_id, round(avg(bler + retx + lost_pdus), 8) as mean
 from {BRONZE_SQL} group by 1""")
def agg_row_sum_mean(load: Tables):
    total = stats.row_sum([F.col(c) for c in ("bler", "retx", "lost_pdus")])
    return rounded(load(BRONZE).groupBy("run_id").agg(F.avg(total).alias("mean")), 8, "mean")


def _quantile_sql(measurands, points) -> str:
    parts = [
        f"select run_id, '{m}' as measurand, 'quantile' as feature_type, '{p}' as feature_value,"
        f" quantile_disc({m}, {p}) as value from {BRONZE_SQL} group by 1"
        for m in measurands for p in points
    ]
    return " union all ".join(parts)


FEATURE_QUANTILES_SQL = _quantile_sql(("dl_tput", "mcs"), (0.05, 0.25, 0.5, 0.75, 0.95))


@query("feature_quantiles", FEATURE_QUANTILES_SQL)
def feature_quantiles(load: Tables):
    return features.feature_quantiles(load(BRONZE), "run_id", ["dl_tput", "mcs"])


@query("feature_quantiles_short", _quantile_sql(("dl_tput", "mcs"), (0.25, 0.5, 0.75)))
def feature_quantiles_short(load: Tables):
    return features.short_quantiles(load(BRONZE), "run_id", ["dl_tput", "mcs"])


def _proportion_sql(measurands) -> str:
    parts = [
        f"select run_id, '{m}' as measurand, round({m}, {d}) as reading, count(*) as n from {BRONZE_SQL}"
        f" where {m} is not null group by 1, 2, 3"
        for m, d in measurands.items()
    ]
    return (
        "select *, n / sum(n) over (partition by run_id, measurand) as value"
        f" from ({' union all '.join(parts)})"
    )


DISCRETE = {"bler": 2, "lost_pdus": 2, "rsrq": 1}
PROPORTIONS_SQL = _proportion_sql(DISCRETE)


@query("feature_proportions", PROPORTIONS_SQL)
def feature_proportions(load: Tables):
    return features.feature_proportions(load(BRONZE), "run_id", DISCRETE)


MATRIX = [f"{m}-q_{p}" for m in ("dl_tput", "mcs") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]


@query("feature_matrix_pivot", f"""select run_id, {', '.join(
    f'max(value) filter (where measurand = {m.split("-q_")[0]!r} and feature_value = {m.split("-q_")[1]!r}) as "{m}"'
    for m in MATRIX)} from ({FEATURE_QUANTILES_SQL}) group by 1""")
def feature_matrix_pivot(load: Tables):
    long = features.feature_quantiles(load(BRONZE), "run_id", ["dl_tput", "mcs"]).withColumn(
        "feature", F.concat_ws("-q_", "measurand", "feature_value")
    )
    return features.feature_matrix(long, "run_id", "feature", "value", MATRIX)


@query("benchmark_features", f"""select run_id,
 count(*) filter (where round(rsrq, 1) = -10.5) / count(*) as x15,
 quantile_disc(bler, 0.95) as x42,
 count(*) filter (where round(retx_1, 1) = 0) / count(*) as x148,
 quantile_disc(pdu_size, 0.25) as x182,
 count(*) filter (where round(retx_1, 1) = 0) / count(*) between 0.925 and 0.945 as x148_in_range,
 quantile_disc(pdu_size, 0.25) between 268.2 and 268.7 as x182_in_range
 from {BRONZE_SQL} group by 1""")
def benchmark_features(load: Tables):
    here = {"x15": "rsrq", "x42": "bler", "x148": "retx_1", "x182": "pdu_size"}
    return features.benchmark_features(load(BRONZE), "run_id", [
        Benchmark(b.name, here[b.name], b.kind, b.at, b.low, b.high, b.decimals)
        for b in features.BENCHMARKS
    ])


KPI_SQL = {
    "harq_efficiency": "retx_0_mean / nullif(retx_total_mean, 0)",
    "bler_spread": "bler_q95 - bler_q05",
    "spectral_efficiency": "dl_throughput_mean / nullif(mcs_mean, 0)",
    "pdcp_discard_rate": "pdcp_lost_pdus_mean / nullif(pdcp_sdu_tput_mean, 0)",
    "dl_ul_asymmetry": "dl_throughput_mean / nullif(mac_tx_agg_tput_mean, 0)",
}


def _kpi(name: str) -> None:
    @query(f"kpi_{name}", f"select run_id, cipher_state, {KPI_SQL[name]} as {name} from {SILVER_SQL}")
    def build(load: Tables):
        return gold.kpi(silver.run_features(silver.gathered(load(NATIVE)), gold.GOLD_FAMILIES), name)


for _name in gold.KPIS:
    _kpi(_name)

GOLD_SQL = f"""(select run_id, cipher_state, tranche, session, row_count,
 {', '.join(f'{text} as {name}' for name, text in KPI_SQL.items())},
 bler_mean, retx_mean, rsrq_mean, mcs_mean, dl_throughput_mean as dl_throughput_mean_kbps from {SILVER_SQL})"""


def gold_of(load: Tables):
    return gold.gold_kpis(silver.run_features(silver.gathered(load(NATIVE)), gold.GOLD_FAMILIES))


@query("gold_domain_kpis", f"select * from {GOLD_SQL}")
def gold_domain_kpis(load: Tables):
    return gold_of(load)


@query("kpi_variants", f"""select run_id, cipher_state,
 retx_0_mean / nullif(retx_0_mean + retx_1_mean, 0) as harq_ack_share,
 dl_throughput_mean / 10 as throughput_per_mhz, bler_q95 - bler_q05 as bler_spread,
 pdcp_lost_pdus_mean / nullif(retx_total_mean, 0) as discard_share,
 dl_throughput_q50 / nullif(mac_tx_agg_tput_q50, 0) as median_asymmetry from {SILVER_SQL}""")
def kpi_variants(load: Tables):
    return gold.kpi_variants(
        silver.run_features(silver.gathered(load(NATIVE)), gold.GOLD_FAMILIES),
        acks="retx_0_mean", nacks="retx_1_mean", cell_throughput="dl_throughput_mean",
        discards="pdcp_lost_pdus_mean", pdus="retx_total_mean",
        median_dl="dl_throughput_q50", median_ul="mac_tx_agg_tput_q50",
    )


@query("src_gold", f"select * from {GOLD_SQL} order by tranche, session, run_id")
def src_gold(load: Tables):
    return silver.ordered(gold_of(load))


FEATURE_VIEW = ("bler_mean", "bler_q25", "bler_q50", "bler_q75", "bler_q95", "retx_mean", "retx_q95",
                "rsrq_mean", "mcs_mean", "dl_throughput_mean", "harq_tb_size_q25")


@query("src_feature_view", f"""select run_id, cipher_state, tranche, session, {', '.join(FEATURE_VIEW)},
 {KPI_SQL['harq_efficiency']} as harq_efficiency, {KPI_SQL['bler_spread']} as bler_spread from {SILVER_SQL}""")
def src_feature_view(load: Tables):
    table = silver.run_features(silver.gathered(load(NATIVE)), [*gold.GOLD_FAMILIES, "harq_tb"])
    return silver.ordered(table.select(
        *silver.IDENTITY, *FEATURE_VIEW,
        gold.harq_efficiency().alias("harq_efficiency"), gold.bler_spread().alias("bler_spread"),
    ))


@query("ordered_output", f"""select run_id, tranche, session, count(*) as n from {BRONZE_SQL}
 group by 1, 2, 3 order by tranche, session, run_id""")
def ordered_output(load: Tables):
    runs = load(BRONZE).groupBy("run_id", "tranche", "session").agg(F.count("*").alias("n"))
    return silver.ordered(runs)
