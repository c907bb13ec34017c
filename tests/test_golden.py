"""The columns of Silver, written out: the operator and its SQL both come from one list, this does not."""

from runlens.operators import silver

SILVER = """
bler_mean bler_stddev bler_q05 bler_q25 bler_q50 bler_q75 bler_q95 bler_nonzero_rate
mcs_mean mcs_stddev mcs_q25 mcs_q50 mcs_q75 snr_mean snr_stddev snr_q25 snr_q50 snr_q75
retx_mean retx_stddev retx_q50 retx_q75 retx_q95 retx_nonzero_rate
retx_0_mean retx_1_mean retx_2_mean retx_3_mean retx_1plus_mean retx_total_mean
harq_tb_size_mean harq_tb_size_q25 harq_tb_size_q50 harq_tb_size_q75
dl_throughput_mean dl_throughput_stddev dl_throughput_q25 dl_throughput_q50 dl_throughput_q75
rsrq_mean rsrq_stddev rsrq_q05 rsrq_q25 rsrq_q50 rsrq_q75 rsrq_q95
rsrp_mean rsrp_stddev rsrp_q25 rsrp_q50 rsrp_q75
mac_rx_agg_tput_mean mac_rx_agg_tput_q50 mac_rx_pdu_tput_mean mac_rx_pdu_tput_q50 mac_tx_agg_tput_mean mac_tx_agg_tput_q50
pdcp_lost_pdus_mean pdcp_lost_pdu_rate_mean pdcp_agg_lost_pdu_rate_mean pdcp_sdu_tput_mean pdcp_sdu_tput_q50 pdcp_agg_sdu_tput_mean
rlc_lost_pdus_mean rlc_lost_pdu_rate_mean rlc_rx_sdu_tput_mean rlc_rx_sdu_tput_q50 rlc_rx_total_tput_mean
""".split()
DECIMALS = {
    "bler": 8, "mcs": 6, "snr": 6, "retx": 8, "retx_0": 6, "retx_1": 6, "retx_2": 6, "retx_3": 6, "retx_1plus": 6, "retx_total": 6,
    "harq_tb_size": 6, "dl_throughput": 4, "rsrq": 6, "rsrp": 6, "mac_rx_agg_tput": 4, "mac_rx_pdu_tput": 4, "mac_tx_agg_tput": 4,
    "pdcp_lost_pdus": 8, "pdcp_lost_pdu_rate": 8, "pdcp_agg_lost_pdu_rate": 8, "pdcp_sdu_tput": 4, "pdcp_agg_sdu_tput": 4,
    "rlc_lost_pdus": 8, "rlc_lost_pdu_rate": 8, "rlc_rx_sdu_tput": 4, "rlc_rx_total_tput": 4,
}


def test_silver_columns():
    assert [n for f in silver.FEATURES for n in f.names()] == SILVER and len(SILVER) == 68
    assert {f.stem: f.decimals for f in silver.FEATURES} == DECIMALS


def test_silver_of_a_known_run(spark):
    """Five rows of one measurement, by hand."""
    from pyspark.sql import functions as F

    rows = [("r", "on", "A", "S", f"t{i}", v) for i, v in enumerate([0.0, 0.1, 0.2, 0.3, 0.9])]
    sources = {c for f in silver.FEATURES if f.family == "bler" for c in f.sources}
    df = spark.createDataFrame(rows, "run_id string, cipher_state string, tranche string, session string, measurement_ts string, v double")
    found = silver.run_features(df.withColumns({c: F.col("v") for c in sources}), ["bler"]).first()
    assert (found.row_count, found.measurement_ts, found.bler_mean, found.bler_nonzero_rate) == (5, "t0", 0.3, 0.8)
    assert (found.bler_q05, found.bler_q25, found.bler_q50, found.bler_q75, found.bler_q95) == (0.0, 0.1, 0.2, 0.3, 0.9)
    assert found.bler_stddev == 0.35355339
