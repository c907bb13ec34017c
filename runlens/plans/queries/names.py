"""Projections, filters and scalar functions (P), and the label join."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.constants import ESSENTIAL_GROUPS
from runlens.functions import catalogue as features
from runlens.functions import labels, names
from runlens.operators import catalogue, rows, trim
from runlens.operators.manifest import label_lookup, with_labels
from runlens.plans.registry import Tables, query
from runlens.plans.views import BRONZE, CATALOGUE, FEATURES, FOLDERS, GROUPS, View

FOLDERS_SQL, BRONZE_SQL, GROUPS_SQL = FOLDERS.sql(), BRONZE.sql(), GROUPS.sql()
FEATURES_SQL, CATALOGUE_SQL = FEATURES.sql(), CATALOGUE.sql()

NAMED_GROUPS = View("events", [
    "user_id as run_id", "event_id", "value",
    "case event_type when 'click' then 'UECOMBINED_MACRXSTATS_ALL'"
    " when 'view' then 'UECOMBINED_L1CARRIERPOWERS' when 'error' then 'L1CELLWATCH_NA'"
    " when 'signup' then 'Odd Group (with) Many-Characters' else event_type end as grp",
])
NAMED_SQL = NAMED_GROUPS.sql()
ESSENTIAL_SQL = ", ".join(f"'{g}'" for g in ESSENTIAL_GROUPS)

LABEL_SQL = """case when lower(run_name) like 'cipheron%' then 'on'
 when lower(run_name) like 'cipheroff%' then 'off' end"""
DB_SQL = """case when lower(trim(enb)) in ('on', '1', 'true', 'enabled', 'cipheron') then 'on'
 when lower(trim(enb)) in ('off', '0', 'false', 'disabled', 'cipheroff') then 'off' end"""
LAYER_SQL = """case when coalesce(layer_raw, '') = '' then 'Unknown'
 when lower(layer_raw) like '%physical layer%'
   or lower(layer_raw) like '%dl control channel (pdcch, pcfich, phich)%' then 'L1 Physical'
 when lower(layer_raw) like '%mac layer%' then 'L2 MAC'
 when lower(layer_raw) like '%rlc layers%' then 'L2 RLC'
 when lower(layer_raw) like '%pdcp layer (overview of the cell)%' then 'L2 PDCP'
 when lower(layer_raw) like '%application layer%'
   or lower(layer_raw) like '%system layers (overview of the cell)%' then 'L3/App/System'
 when lower(layer_raw) like '%network%' then 'Wireshark' else 'Other' end"""
PARSED_SQL = f"""(select new_var_num, orig_var_name,
 case when regexp_matches(orig_var_name, '^(.+)-q_([0-9.]+)$') then regexp_extract(orig_var_name, '^(.+)-q_([0-9.]+)$', 1)
  when regexp_matches(orig_var_name, '^(.+)-r_(.+)$') then regexp_extract(orig_var_name, '^(.+)-r_(.+)$', 1)
  else orig_var_name end as measurand_prefix,
 case when regexp_matches(orig_var_name, '^(.+)-q_([0-9.]+)$') then 'quantile'
  when regexp_matches(orig_var_name, '^(.+)-r_(.+)$') then 'proportion' else 'metadata' end as feature_type,
 case when regexp_matches(orig_var_name, '^(.+)-q_([0-9.]+)$') then regexp_extract(orig_var_name, '^(.+)-q_([0-9.]+)$', 2)
  when regexp_matches(orig_var_name, '^(.+)-r_(.+)$') then regexp_extract(orig_var_name, '^(.+)-r_(.+)$', 2)
  end as feature_value
 from {FEATURES_SQL})"""


@query("normalize_columns", """select l_suppkey as run_id, l_quantity as "mean_mcs", l_tax as "dl-sch_bler"
 from lineitem""")
def normalize_columns(load: Tables):
    raw = load("lineitem").select("l_suppkey", "l_quantity", "l_tax")
    return names.normalize_columns(raw.toDF("Run ID", " Mean MCS", "DL-SCH BLER"))


@query("sanitize_columns", """select l_suppkey as run_id, l_quantity as "snr__cw__0__db_", l_tax as dl_sch_bler
 from lineitem""")
def sanitize_columns(load: Tables):
    raw = load("lineitem").select("l_suppkey", "l_quantity", "l_tax")
    return names.sanitize_columns(raw.toDF("Run ID", "SNR (CW: 0)(dB)", "DL-SCH BLER"))


@query("group_prefix", f"""select grp, case grp when 'UECOMBINED_MACRXSTATS_ALL' then 'mac_rx'
 when 'UECOMBINED_L1CARRIERPOWERS' then 'l1_powers' when 'L1CELLWATCH_NA' then 'l1_watch'
 else substr(regexp_replace(lower(grp), '[^a-z0-9_]', '_', 'g'), 1, 25) end as tag,
 count(*) as n from {NAMED_SQL} group by 1, 2""")
def group_prefix(load: Tables):
    tagged = load(NAMED_GROUPS).withColumn("tag", names.group_tag(F.col("grp")))
    return tagged.groupBy("grp", "tag").agg(F.count("*").alias("n"))


@query("parse_group_name", f"""select run_name, file_stem,
 case when length(file_stem) - length(replace(file_stem, '_', '')) >= 2
 then regexp_replace(file_stem, '^[^_]*_[^_]*_', '') else file_stem end as grp from {FOLDERS_SQL}""")
def parse_group_name(load: Tables):
    return load(FOLDERS).select(
        "run_name", "file_stem", names.group_name(F.col("file_stem")).alias("grp")
    )


@query("parse_measurement_ts", f"""select run_name,
 '20' || substr(file_stem, 1, 2) || '-' || substr(file_stem, 3, 2) || '-' || substr(file_stem, 5, 2)
 || 'T' || substr(file_stem, 8, 2) || ':' || substr(file_stem, 10, 2) || ':' || substr(file_stem, 12, 2)
 as measurement_ts from {FOLDERS_SQL}""")
def parse_measurement_ts(load: Tables):
    stamp = names.measurement_ts(F.col("file_stem"))
    return load(FOLDERS).groupBy("run_name").agg(F.min(stamp).alias("measurement_ts"))


@query("label_from_name", f"select run_name, {LABEL_SQL} as label from {FOLDERS_SQL}")
def label_from_name(load: Tables):
    return load(FOLDERS).select(
        "run_name", labels.label_from_name(F.col("run_name")).alias("label")
    )


@query("label_normalize", f"select run_name, {DB_SQL} as label from {FOLDERS_SQL}")
def label_normalize(load: Tables):
    return load(FOLDERS).select("run_name", labels.normalize_label(F.col("enb")).alias("label"))


RESOLVED_SQL = f"""select run_name, coalesce(a, b, 'unknown') as cipher_state,
 case when a is not null then 'folder' when b is not null then 'db' else 'none' end as cipher_source,
 coalesce(a <> b, false) as label_mismatch
 from (select run_name, {LABEL_SQL} as a, {DB_SQL} as b from {FOLDERS_SQL})"""


@query("resolve_label", RESOLVED_SQL)
def resolve_label(load: Tables):
    resolved = with_labels(load(FOLDERS), "run_name")
    return resolved.select("run_name", "cipher_state", "cipher_source", "label_mismatch")


@query("run_number", f"""select run_name, file_stem,
 coalesce(try_cast(regexp_extract(run_name, '([0-9]+)$', 1) as bigint), -1) as run_number,
 coalesce(try_cast(regexp_extract(file_stem, '([0-9]+)$', 1) as bigint), -1) as stem_number
 from {FOLDERS_SQL}""")
def run_number(load: Tables):
    return load(FOLDERS).select(
        "run_name", "file_stem",
        names.run_number(F.col("run_name")).alias("run_number"),
        names.run_number(F.col("file_stem")).alias("stem_number"),
    )


@query("filter_groups", f"select event_id, grp, value from {NAMED_SQL} where grp in ({ESSENTIAL_SQL})")
def filter_groups(load: Tables):
    return rows.filter_groups(load(NAMED_GROUPS), "grp").select("event_id", "grp", "value")


TIME_TRIMMED_SQL = f"""select run_id, grp, event_id, ts, value from (select *,
 min(ts) over (partition by run_id, grp) as a, max(ts) over (partition by run_id, grp) as b from {GROUPS_SQL})
 where ts >= a + interval 1 day and ts <= b - interval 1 day"""


@query("time_trim", TIME_TRIMMED_SQL)
def time_trim(load: Tables):
    trimmed = trim.time_trim(load(GROUPS), ["run_id", "grp"], "ts", F.expr("interval '1' day"))
    return trimmed.select("run_id", "grp", "event_id", "ts", "value")


ROW_TRIMMED_SQL = f"""select run_id, grp, event_id, value from (select *,
 row_number() over (partition by run_id, grp order by ts, event_id) as r,
 count(*) over (partition by run_id, grp) as n from {GROUPS_SQL})
 where n <= 2 * least(25, greatest(1, n // 20))
 or (r > least(25, greatest(1, n // 20)) and r <= n - least(25, greatest(1, n // 20)))"""


@query("row_trim", ROW_TRIMMED_SQL)
def row_trim(load: Tables):
    trimmed = trim.row_trim(load(GROUPS), ["run_id", "grp"], ["ts", "event_id"])
    return trimmed.select("run_id", "grp", "event_id", "value")


@query("drop_empty_groups", f"""select run_id, grp, count(*) as n from {GROUPS_SQL} g
 where exists (select 1 from (select run_id, grp, ts,
   min(ts) over (partition by run_id, grp) as a, max(ts) over (partition by run_id, grp) as b
   from {GROUPS_SQL}) k where k.run_id = g.run_id and k.grp = g.grp
   and k.ts >= k.a + interval 13 day and k.ts <= k.b - interval 13 day) group by 1, 2""")
def drop_empty_groups(load: Tables):
    keys = ["run_id", "grp"]
    groups = load(GROUPS)
    kept = trim.time_trim(groups, keys, "ts", F.expr("interval '13' day"))
    return rows.drop_empty_groups(groups, kept, keys).groupBy(*keys).agg(F.count("*").alias("n"))


@query("attach_metadata", f"""select m.run_id, m.cipher_state, m.tranche, g.event_id, g.grp, g.value
 from (select user_id as run_id, event_id, event_type as grp, value from events) g join
 (select run_no as run_id, {LABEL_SQL} as cipher_state, tranche from {FOLDERS_SQL}) m using (run_id)""")
def attach_metadata(load: Tables):
    runs = load(FOLDERS).select(
        F.col("run_no").alias("run_id"),
        labels.label_from_name(F.col("run_name")).alias("cipher_state"),
        "tranche",
    )
    measured = load("events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("grp"), "value"
    )
    return rows.attach_metadata(measured, runs, ["run_id"])


@query("canonical_types", """select event_id, case when event_type in ('error', 'signup', 'view') then null
 else value end as value, cast(user_id as double) as reading from events""")
def canonical_types(load: Tables):
    raw = load("events").selectExpr(
        "event_id",
        "case event_type when 'error' then 'NaN' when 'signup' then '' when 'view' then 'n/a'"
        " else cast(value as string) end as value",
        "cast(user_id as string) as reading",
    )
    return rows.canonical_types(raw, ["value", "reading"])


@query("harmonize_dtype", """select l_orderkey, l_partkey, cast(l_linenumber as double) as retransmission_1,
 l_tax as retransmission_2 from lineitem""")
def harmonize_dtype(load: Tables):
    raw = load("lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").alias("retransmission_1"),
        F.col("l_tax").alias("retransmission_2"),
    )
    return rows.harmonize(raw, "retransmission")


@query("parse_feature_name", f"select * from {PARSED_SQL}")
def parse_feature_name(load: Tables):
    return load(FEATURES).withColumns(features.parse_feature_name(F.col("orig_var_name")))


@query("assign_layer", f"select pos, layer_raw, {LAYER_SQL} as layer_group from {CATALOGUE_SQL}")
def assign_layer(load: Tables):
    return load(CATALOGUE).select(
        "pos", "layer_raw", features.layer_of_text(F.col("layer_raw")).alias("layer_group")
    )


FEATURE_LAYER_SQL = """case when starts_with(lower(orig_var_name), 'l1') then 'L1 Physical'
 when starts_with(lower(orig_var_name), 'vsa') then 'L1 Physical'
 when starts_with(lower(orig_var_name), 'mac') then 'L2 MAC'
 when starts_with(lower(orig_var_name), 'rlc') then 'L2 RLC'
 when starts_with(lower(orig_var_name), 'pdcp') then 'L2 PDCP'
 when starts_with(lower(orig_var_name), 'sys') then 'L3/App/System'
 when starts_with(lower(orig_var_name), 'wireshark') then 'Wireshark' else 'Metadata/Other' end"""


@query("layer_by_prefix", f"select new_var_num, {FEATURE_LAYER_SQL} as layer_group from {FEATURES_SQL}")
def layer_by_prefix(load: Tables):
    return load(FEATURES).select(
        "new_var_num", features.layer_of_feature(F.col("orig_var_name")).alias("layer_group")
    )


SIZES = View(FOLDERS, [
    "run_name",
    "n_rows * case run_no % 3 when 0 then 123456789 when 1 then 1234567 else 1234 end as size",
])


@query("format_bytes", f"""select run_name, case
 when size >= 1e9 then printf('%d.%02d GB', (size + 5000000) // 1000000000, (size + 5000000) // 10000000 % 100)
 when size >= 1e6 then printf('%d.%d MB', (size + 50000) // 1000000, (size + 50000) // 100000 % 10)
 else printf('%d.%d KB', (size + 50) // 1000, (size + 50) // 100 % 10) end as text from {SIZES.sql()}""")
def format_bytes(load: Tables):
    return load(SIZES).select("run_name", names.format_bytes(F.col("size")).alias("text"))


@query("filter_runs", f"""select run_id, cipher_state, tranche, bler from {BRONZE_SQL}
 where tranche in ('Tranche_A', 'Tranche_C') and cipher_state in ('on')""")
def filter_runs(load: Tables):
    kept = rows.filter_runs(load(BRONZE), ["Tranche_A", "Tranche_C"], ["on"])
    return kept.select("run_id", "cipher_state", "tranche", "bler")


@query("label_display", f"""select run_id, case cipher_state when 'on' then 'Cipher ON (normal)'
 when 'off' then 'Cipher OFF (misconfigured)' end as label, count(*) as n from {BRONZE_SQL} group by 1, 2""")
def label_display(load: Tables):
    shown = load(BRONZE).select("run_id", labels.label_display(F.col("cipher_state")).alias("label"))
    return shown.groupBy("run_id", "label").agg(F.count("*").alias("n"))


@query("truncate_text", f"""select pos, substr(coalesce(description, ''), 1, 90) as description
 from {CATALOGUE_SQL}""")
def truncate_text(load: Tables):
    return load(CATALOGUE).select(
        "pos", names.truncate_text(F.col("description")).alias("description")
    )


@query("round_features", f"""select l_orderkey, l_partkey, round(dl_tput / 7, 4) as dl_tput,
 round(bler / 7, 6) as bler, round(retx / 7, 8) as retx from {BRONZE_SQL}""")
def round_features(load: Tables):
    raw = load(BRONZE).selectExpr(
        "l_orderkey", "l_partkey", "dl_tput / 7 as dl_tput", "bler / 7 as bler", "retx / 7 as retx"
    )
    return rows.round_columns(raw, {"dl_tput": 4, "bler": 6, "retx": 8})


@query("partition_by_label", f"""select cipher_state, run_id, count(*) as n from {BRONZE_SQL}
 where cipher_state in ('on', 'off') group by 1, 2""")
def partition_by_label(load: Tables):
    on, off = rows.split_by_label(load(BRONZE))
    keys = ("cipher_state", "run_id")
    return on.unionByName(off).groupBy(*keys).agg(F.count("*").alias("n"))


@query("catalogue_project", f"""select {LAYER_SQL} as layer_group, coalesce(layer_raw, '') as layer_raw,
 coalesce(ue_logging, '') as ue_logging, coalesce(meas_key, '') as meas_key, cast(priority as bigint) as priority,
 coalesce(key_type, '') as key_type, coalesce(data_type, '') as data_type, min_value, max_value,
 coalesce(description, '') as description from {CATALOGUE_SQL}""")
def catalogue_project(load: Tables):
    return catalogue.catalogue_rows(load(CATALOGUE))


@query("select_tranche", f"""select run_id, tranche, session, bler from {BRONZE_SQL}
 where tranche = 'Tranche_B'""")
def select_tranche(load: Tables):
    return rows.select_tranche(load(BRONZE), "Tranche_B").select("run_id", "tranche", "session", "bler")


@query("label_lookup_join", f"""select tranche, session, run_name as run_id,
 case when top_purchase > 15 then enb end as enb from {FOLDERS_SQL}""")
def label_lookup_join(load: Tables):
    folders = load(FOLDERS)
    table = folders.where("top_purchase > 15").select(
        "tranche", "session", F.col("run_name").alias("name"), "enb"
    )
    runs = folders.select("tranche", "session", F.col("run_name").alias("run_id"))
    return label_lookup(runs, table)


