"""The test tables seen as telemetry: one text per view, read by Spark and by the oracle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """A projection, or a grouping, of a table or of another view."""

    source: str | View
    columns: Sequence[str]
    group: int = 0  # the first so many columns are grouping keys
    where: str | None = None

    def sql(self) -> str:
        inner = self.source if isinstance(self.source, str) else self.source.sql() + " t"
        text = f"select {', '.join(self.columns)} from {inner}"
        if self.where:
            text += f" where {self.where}"
        if self.group:
            text += f" group by {', '.join(str(i + 1) for i in range(self.group))}"
        return f"({text})"

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if isinstance(self.source, str):
            base = spark.read.parquet(f"{sf_dir}/{self.source}.parquet")
        else:
            base = self.source.load(spark, sf_dir)
        if self.where:
            base = base.where(self.where)
        if not self.group:
            return base.selectExpr(*self.columns)
        keys = [F.expr(c) for c in self.columns[: self.group]]
        return base.groupBy(*keys).agg(*[F.expr(c) for c in self.columns[self.group :]])


_LI_IDENTITY = [
    "l_suppkey as run_id",
    "case when l_suppkey % 2 = 0 then 'on' else 'off' end as cipher_state",
    "concat('Tranche_', substr('ABC', cast(l_suppkey % 3 as int) + 1, 1)) as tranche",
    "concat('Session_', cast(cast(floor(l_suppkey / 12) as int) + 1 as varchar(10))) as session",
]

# Measurement rows with short names; lost_pdus has nulls, dl_tput is continuous.
BRONZE = View("lineitem", [
    *_LI_IDENTITY,
    "l_shipdate as ts", "l_orderkey", "l_linenumber", "l_partkey",
    "l_discount as bler", "l_tax as retx", "l_quantity as mcs", "l_extendedprice as dl_tput",
    "nullif(l_tax, 0.03) as lost_pdus",
    "-10 - l_discount * 5 as rsrq",
    "case when l_linenumber = 7 then 1e0 else 0e0 end as retx_1",
    "268 + l_tax * 8 as pdu_size",
])

# Measurement rows under the native column names. The factors avoid exact rounding ties.
NATIVE = View("lineitem", [
    *_LI_IDENTITY,
    "l_shipdate as measurement_ts",
    "l_discount as l1_dl_carrier__dl_sch_bler",
    "l_quantity * 0.5e0 as l1_dl_carrier__mean_mcs",
    "l_extendedprice / 2000 as l1_dl_carrier__snr__cw__0__db_",
    "l_tax as l1_dl_carrier__average_retransmission_count",
    "l_quantity * 10 + l_linenumber as l1_dl_carrier__mean_harq_tb_size__cw__0__bytes_",
    "l_extendedprice as l1_dl_carrier__dl_sch_throughput_kbps_",
    "-10 - l_discount as l1_powers__real_rsrq__pcc__db_",
    "l_tax * 80 - 72 as l1_powers__real_rsrp__pcc__dbm_",
    "l_extendedprice * (1 - l_discount) as mac_rx__aggregate_sdu_throughput_kbps_",
    "l_extendedprice * (1 + l_tax) as mac_rx__pdu_throughput_kbps_",
    "l_extendedprice * 0.25e0 as mac_tx__aggregate_sdu_throughput_kbps_",
    "case when l_linenumber = 7 then 1e0 else 0e0 end as pdcp_rx__lost_pdus",
    "l_tax * 10 as pdcp_rx__lost_pdu_rate_packet_sec_",
    "nullif(l_tax, 0.03) * 20 as pdcp_rx__aggregate_lost_pdu_rate_packet_sec_",
    "l_extendedprice * 0.75e0 as pdcp_rx__sdu_throughput_kbps_",
    "l_extendedprice * 1.5e0 as pdcp_rx__aggregate_sdu_throughput_kbps_",
    "nullif(l_tax, 0.05) as rlc_rx__lost_pdus",
    "l_tax * 5 as rlc_rx__lost_pdu_rate_packet_sec_",
    "l_extendedprice * 0.5e0 as rlc_rx__sdu_throughput_kbps_",
    "l_extendedprice * 0.625e0 as rlc_rx__total_throughput_kbps_",
    "l_quantity + 50 as l1_dl_carrier__retransmission_0",
    "l_linenumber * 0.7e0 as l1_dl_carrier__retransmission_1",
    "nullif(l_tax, 0.08) as l1_dl_carrier__retransmission_2",
    "l_discount as l1_dl_carrier__retransmission_3",
    "l_tax as l1_dl_carrier__retransmission_4",
    "l_discount * l_tax as l1_dl_carrier__retransmission_5",
])

# One row per run, with its size.
RUNS = View(BRONZE, ["run_id", "cipher_state", "tranche", "session", "count(*) as row_count"], group=4)

# Measurement groups of different length per run; (ts, event_id) is a unique order.
GROUPS = View("events", [
    "user_id as run_id", "event_type as grp", "ts", "event_id",
    "nullif(value, 10.0) as value",
    "case when user_id % 2 = 0 then 'on' else 'off' end as cipher_state",
])
# The same with one group missing from some runs.
GROUPS_MISSING = View("events", [
    "user_id as run_id",
    "case when user_id % 10 = 0 and event_type = 'click' then 'view' else event_type end as grp",
    "ts", "event_id", "value",
])
GROUP_NAMES = ("click", "error", "purchase", "signup", "view")

# Run folders, file stems and the spellings of their session's label table.
FOLDERS = View(
    View("events", [
        "user_id as run_no", "count(*) as n_rows", "upper(min(event_type)) as first_type",
        "max(case when event_type = 'purchase' then value end) as top_purchase",
    ], group=1),
    [
        "run_no",
        "concat('Tranche_', substr('ABC', cast(run_no % 3 as int) + 1, 1)) as tranche",
        "concat('Session_', cast(cast(floor(run_no / 12) as int) + 1 as varchar(10))) as session",
        "case when run_no % 7 = 0 then concat('cipher_', cast(run_no as varchar(10)))"
        " when run_no % 2 = 0 then concat('cipheron_', cast(run_no as varchar(10)))"
        " else concat('CipherOff_', cast(run_no as varchar(10))) end as run_name",
        "case when run_no % 21 = 0 then null when run_no % 11 = 0 then 'enabled'"
        " when run_no % 2 = 0 then '1' else ' Off ' end as enb",
        "n_rows", "top_purchase",
        "concat('2401', lpad(cast(run_no % 28 + 1 as varchar(10)), 2, '0'), '_1205',"
        " lpad(cast(run_no % 60 as varchar(10)), 2, '0'),"
        " case when run_no % 13 = 0 then '' else concat('_', first_type) end) as file_stem",
    ],
)

# A finished manifest with every outcome in it.
MANIFEST = View(FOLDERS, [
    "run_name as run_id", "run_no as run_number", "tranche", "session",
    "case when run_no % 21 = 0 then 'unknown' when run_no % 2 = 0 then 'on' else 'off' end as cipher_state",
    "run_no % 11 = 0 and run_no % 2 = 1 as label_mismatch",
    "n_rows as row_count",
    "n_rows * 1234567 as raw_size_bytes",
    "case when run_no % 5 = 0 then 0 else n_rows * 31459 end as parquet_size_bytes",
    "case when run_no % 5 = 0 then '' else concat(tranche, '/', session, '/', run_name, '.parquet') end as parquet_path",
    "case when run_no % 15 = 0 then 'skip' when run_no % 5 = 0 then 'quarantine' else 'ok' end as outcome",
    "case when run_no % 15 = 0 then 'no traffic_generator folder'"
    " when run_no % 10 = 0 then 'cipher state unknown'"
    " when run_no % 5 = 0 then concat('too few rows after trimming: ', cast(n_rows as varchar(10)))"
    " else '' end as skip_reason",
])

# Listing of stored files: runs without a large enough purchase have none.
STORED = View(
    FOLDERS,
    ["concat(tranche, '/', session, '/', run_name, '.parquet') as parquet_path", "run_name as run_id"],
    where="top_purchase > 19",
)
# Log of pipeline entries: a run passed unless its top purchase is small.
PIPELINE_LOG = View(
    FOLDERS,
    ["run_name as run_id", "case when top_purchase > 15 then 'pass' else 'fail' end as status"],
)

# The feature dictionary.
FEATURES = View("part", [
    "concat('x', cast(p_partkey + 1 as varchar(10))) as new_var_num",
    "concat(case p_type when 'ECONOMY' then 'l1' when 'SMALL' then 'mac' when 'LARGE' then 'rlc'"
    " when 'MEDIUM' then 'pdcp' when 'PROMO' then 'sys' else '' end, replace(lower(p_name), ' ', '_'),"
    " case when p_size % 3 = 0 then '-q_0.95' when p_size % 3 = 1 then '-r_0.0' else '' end) as orig_var_name",
])

# The measurand catalogue: a row per part family, in order of first appearance.
CATALOGUE = View(
    View("part", [
        "p_name", "p_type", "min(p_partkey) as pos", "sum(p_size) as total", "count(*) as n",
        "min(p_retailprice) as min_value", "max(p_retailprice) as max_value", "max(p_brand) as brand",
    ], group=2),
    [
        "pos",
        "case p_type when 'ECONOMY' then 'Physical Layer (per UE)' when 'SMALL' then 'MAC Layer'"
        " when 'LARGE' then 'RLC Layers' when 'MEDIUM' then 'DL PDCP Layer (Overview of the Cell)'"
        " when 'PROMO' then 'System Layers (Overview of the Cell)' when 'STANDARD' then ''"
        " else p_type end as layer_raw",
        "case when total % 3 = 0 then null when total % 3 = 1 then replace(p_name, ' ', '_')"
        " else upper(split_part(p_name, ' ', 2)) end as ue_logging",
        "case when total % 5 = 0 then null else concat(p_type, '_', p_name) end as meas_key",
        "total % 4 as priority",
        "case n % 3 when 0 then 'continuous (q = 5)' when 1 then 'discrete' else 'NA' end as key_type",
        "case when n % 2 = 0 then 'float' else null end as data_type",
        "min_value", "max_value",
        "case when n % 7 = 0 then null else concat('Readings of ', p_name, ' by ', brand,"
        " ' as seen by the measuring unit during one complete run of the experiment') end as description",
    ],
)

# Run-level table for the models, with a planted shift that only partly separates the classes.
ML = View(
    View("lineitem", [
        "l_suppkey as run_id",
        "case when floor(l_suppkey / 3) % 2 = 0 then 'on' else 'off' end as cipher_state",
        "concat('Tranche_', substr('ABC', cast(l_suppkey % 3 as int) + 1, 1)) as tranche",
        "l_discount as bler", "l_extendedprice as dl_tput", "l_tax as retx", "l_quantity as mcs",
    ]),
    [
        "run_id", "cipher_state", "tranche",
        "round(avg(bler + case when cipher_state = 'on' then 0.002e0 else 0e0 end), 7) as bler_mean",
        "round(avg(dl_tput), 3) as dl_throughput_mean",
        "round(avg(retx), 7) as retx_mean",
        "round(avg(mcs), 5) as mcs_mean",
        "count(*) as row_count",
    ],
    group=3,
)
