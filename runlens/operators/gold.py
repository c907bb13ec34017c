"""Domain KPIs of a run. Divisions give null where the lower term is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(upper: str, lower: str) -> Column:
    return F.try_divide(F.col(upper), F.col(lower))


def harq_efficiency() -> Column:
    """Share of transmissions that got through at the first attempt."""
    return _ratio("retx_0_mean", "retx_total_mean")


def bler_spread() -> Column:
    return F.col("bler_q95") - F.col("bler_q05")


def spectral_efficiency() -> Column:
    return _ratio("dl_throughput_mean", "mcs_mean")


def pdcp_discard_rate() -> Column:
    return _ratio("pdcp_lost_pdus_mean", "pdcp_sdu_tput_mean")


def dl_ul_asymmetry() -> Column:
    return _ratio("dl_throughput_mean", "mac_tx_agg_tput_mean")


KPIS = {
    "harq_efficiency": harq_efficiency,
    "bler_spread": bler_spread,
    "spectral_efficiency": spectral_efficiency,
    "pdcp_discard_rate": pdcp_discard_rate,
    "dl_ul_asymmetry": dl_ul_asymmetry,
}
GOLD_FAMILIES = ("bler", "mcs", "retx", "retx_breakdown", "retx_derived", "dl_tput", "rsrq",
                 "mac", "pdcp")
BANDWIDTH_MHZ = 10.0


def kpi(silver: DataFrame, name: str) -> DataFrame:
    """One KPI next to its run."""
    return silver.select("run_id", "cipher_state", KPIS[name]().alias(name))


def gold_kpis(silver: DataFrame) -> DataFrame:
    """The KPI table: identity, size, five KPIs, five means."""
    return silver.select(
        "run_id", "cipher_state", "tranche", "session", "row_count",
        *[build().alias(name) for name, build in KPIS.items()],
        "bler_mean", "retx_mean", "rsrq_mean", "mcs_mean",
        F.col("dl_throughput_mean").alias("dl_throughput_mean_kbps"),
    )


def kpi_variants(
    silver: DataFrame,
    acks: str,
    nacks: str,
    cell_throughput: str,
    discards: str,
    pdus: str,
    median_dl: str,
    median_ul: str,
) -> DataFrame:
    """The same KPIs by the catalogue's definitions."""
    return silver.select(
        "run_id", "cipher_state",
        F.try_divide(F.col(acks), F.col(acks) + F.col(nacks)).alias("harq_ack_share"),
        (F.col(cell_throughput) / BANDWIDTH_MHZ).alias("throughput_per_mhz"),
        bler_spread().alias("bler_spread"),
        _ratio(discards, pdus).alias("discard_share"),
        _ratio(median_dl, median_ul).alias("median_asymmetry"),
    )
