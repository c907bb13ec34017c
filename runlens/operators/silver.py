"""The per-run feature table: one aggregate over the measurement rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.stats import ACCURACY, quantiles, row_sum, share

IDENTITY = ("run_id", "cipher_state", "tranche", "session")


@dataclass(frozen=True)
class Feature:
    """Statistics of one measurement (or of the row-wise sum of several)."""

    family: str
    stem: str
    sources: tuple[str, ...]
    decimals: int
    stats: tuple[str, ...]

    def names(self) -> list[str]:
        return [f"{self.stem}_{s}" for s in self.stats]

    def points(self) -> list[str]:
        return [s for s in self.stats if s[0] == "q" and s[1:].isdigit()]

    def value(self) -> Column:
        return row_sum([F.col(c) for c in self.sources])


def _feature(family: str, stem: str, source: str | Sequence[str], decimals: int, stats: str) -> Feature:
    sources = (source,) if isinstance(source, str) else tuple(source)
    return Feature(family, stem, sources, decimals, tuple(stats.split()))


def _attempts(first: int) -> list[str]:
    return [f"l1_dl_carrier__retransmission_{i}" for i in range(first, 6)]


# The features, their sources and their decimals, in output order.
FEATURES = (
    _feature("bler", "bler", "l1_dl_carrier__dl_sch_bler", 8,
             "mean stddev q05 q25 q50 q75 q95 nonzero_rate"),
    _feature("mcs", "mcs", "l1_dl_carrier__mean_mcs", 6, "mean stddev q25 q50 q75"),
    _feature("snr", "snr", "l1_dl_carrier__snr__cw__0__db_", 6, "mean stddev q25 q50 q75"),
    _feature("retx", "retx", "l1_dl_carrier__average_retransmission_count", 8,
             "mean stddev q50 q75 q95 nonzero_rate"),
    _feature("retx_breakdown", "retx_0", "l1_dl_carrier__retransmission_0", 6, "mean"),
    _feature("retx_breakdown", "retx_1", "l1_dl_carrier__retransmission_1", 6, "mean"),
    _feature("retx_breakdown", "retx_2", "l1_dl_carrier__retransmission_2", 6, "mean"),
    _feature("retx_breakdown", "retx_3", "l1_dl_carrier__retransmission_3", 6, "mean"),
    _feature("retx_derived", "retx_1plus", _attempts(1), 6, "mean"),
    _feature("retx_derived", "retx_total", _attempts(0), 6, "mean"),
    _feature("harq_tb", "harq_tb_size", "l1_dl_carrier__mean_harq_tb_size__cw__0__bytes_", 6,
             "mean q25 q50 q75"),
    _feature("dl_tput", "dl_throughput", "l1_dl_carrier__dl_sch_throughput_kbps_", 4,
             "mean stddev q25 q50 q75"),
    _feature("rsrq", "rsrq", "l1_powers__real_rsrq__pcc__db_", 6,
             "mean stddev q05 q25 q50 q75 q95"),
    _feature("rsrp", "rsrp", "l1_powers__real_rsrp__pcc__dbm_", 6, "mean stddev q25 q50 q75"),
    _feature("mac", "mac_rx_agg_tput", "mac_rx__aggregate_sdu_throughput_kbps_", 4, "mean q50"),
    _feature("mac", "mac_rx_pdu_tput", "mac_rx__pdu_throughput_kbps_", 4, "mean q50"),
    _feature("mac", "mac_tx_agg_tput", "mac_tx__aggregate_sdu_throughput_kbps_", 4, "mean q50"),
    _feature("pdcp", "pdcp_lost_pdus", "pdcp_rx__lost_pdus", 8, "mean"),
    _feature("pdcp", "pdcp_lost_pdu_rate", "pdcp_rx__lost_pdu_rate_packet_sec_", 8, "mean"),
    _feature("pdcp", "pdcp_agg_lost_pdu_rate", "pdcp_rx__aggregate_lost_pdu_rate_packet_sec_", 8,
             "mean"),
    _feature("pdcp", "pdcp_sdu_tput", "pdcp_rx__sdu_throughput_kbps_", 4, "mean q50"),
    _feature("pdcp", "pdcp_agg_sdu_tput", "pdcp_rx__aggregate_sdu_throughput_kbps_", 4, "mean"),
    _feature("rlc", "rlc_lost_pdus", "rlc_rx__lost_pdus", 8, "mean"),
    _feature("rlc", "rlc_lost_pdu_rate", "rlc_rx__lost_pdu_rate_packet_sec_", 8, "mean"),
    _feature("rlc", "rlc_rx_sdu_tput", "rlc_rx__sdu_throughput_kbps_", 4, "mean q50"),
    _feature("rlc", "rlc_rx_total_tput", "rlc_rx__total_throughput_kbps_", 4, "mean"),
)
RATE_DECIMALS = 6
FAMILIES = tuple(dict.fromkeys(f.family for f in FEATURES))


def features_of(families: Iterable[str] | None = None) -> list[Feature]:
    wanted = set(FAMILIES if families is None else families)
    return [f for f in FEATURES if f.family in wanted]


def gathered(rows: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Rows in no order of runs, dealt out by run: ``run_features`` then sketches a run once and shuffles no sketch.

    Without it every task sketches a few rows of every run, and these sketches are larger than the rows. Stored Bronze does not need it. A
    run's rows go to one task, so for a table of a few huge runs leave it out.
    """
    return rows.repartition(*[c for c in identity if c != "cipher_state"])


def run_features(
    bronze: DataFrame,
    families: Iterable[str] | None = None,
    identity: Sequence[str] = IDENTITY,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Bronze rows to one row per run.

    Every measurement has one quantile sketch for all its points. Tasks sketch what they read and
    the sketches, of bounded size, are merged, so a huge run is shared by many tasks. Bronze is stored in run
    order, so most runs are read by one task and sketched once.
    """
    chosen = features_of(families)
    aggregates = [F.min("measurement_ts").alias("measurement_ts"), F.count("*").alias("row_count")]
    columns: list[Column] = []
    for f in chosen:
        if f.points():
            sketch = quantiles(f.value(), [int(q[1:]) / 100 for q in f.points()], accuracy)
            aggregates.append(sketch.alias(f"_{f.stem}_q"))
        for stat in f.stats:
            name = f"{f.stem}_{stat}"
            if stat in f.points():
                point = F.col(f"_{f.stem}_q")[f.points().index(stat)]
                columns.append(F.round(point, f.decimals).alias(name))
                continue
            plain = {"mean": F.avg, "stddev": F.stddev_samp}.get(stat)
            value = plain(f.value()) if plain else share(f.value() > 0)
            aggregates.append(value.alias(name))
            digits = f.decimals if plain else RATE_DECIMALS
            columns.append(F.round(name, digits).alias(name))
    grouped = bronze.groupBy(*identity).agg(*aggregates)
    return grouped.select(*identity, "measurement_ts", "row_count", *columns)


def ordered(df: DataFrame) -> DataFrame:
    """Presentation order of run tables."""
    return df.orderBy("tranche", "session", "run_id")
