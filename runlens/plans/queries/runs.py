"""Run tables: counts, manifest reports, and the comparison of the two classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import compare, manifest, reference
from runlens.plans.queries.names import DB_SQL, LABEL_SQL
from runlens.plans.registry import Tables, query, rounded
from runlens.plans.views import (
    BRONZE, FOLDERS, MANIFEST, ML, PIPELINE_LOG, RUNS, STORED, View,
)
from runlens.session import scratch_path
from runlens.sources import tables

MANIFEST_SQL, FOLDERS_SQL, RUNS_SQL, ML_SQL = MANIFEST.sql(), FOLDERS.sql(), RUNS.sql(), ML.sql()
BRONZE_SQL = BRONZE.sql()
KPIS = ["bler_mean", "dl_throughput_mean", "retx_mean", "mcs_mean"]


def on_off(label: str = "cipher_state") -> str:
    return (
        f"count(*) filter (where {label} = 'on') as n_on, count(*) filter (where {label} = 'off') as n_off"
    )


@query("src_run_counts", f"""select f.tranche, f.session,
 count(distinct f.run_name) filter (where lower(f.run_name) like '%cipheron%') as n_on,
 count(distinct f.run_name) filter (where lower(f.run_name) like '%cipheroff%') as n_off,
 string_agg(distinct e.event_type, ',' order by e.event_type) as groups
 from {FOLDERS_SQL} f join events e on e.user_id = f.run_no group by 1, 2""")
def src_run_counts(load: Tables):
    groups = load("events").select(F.col("user_id").alias("run_no"), "event_type")
    return manifest.run_census(load(FOLDERS).join(groups, "run_no"), "run_name", "event_type")


@query("sink_quarantine", f"""select run_id, tranche, session, skip_reason from {MANIFEST_SQL}
 where outcome = 'quarantine'""")
def sink_quarantine(load: Tables):
    path = scratch_path(load.spark, "quarantine")
    tables.write_table(manifest.quarantined(load(MANIFEST)), path)
    return load.spark.read.parquet(path).select("run_id", "tranche", "session", "skip_reason")


@query("src_manifest", f"select outcome, count(*) as n from {MANIFEST_SQL} group by 1")
def src_manifest(load: Tables):
    """Counted on the file."""
    path, rows = scratch_path(load.spark, "manifest"), load(MANIFEST)
    tables.write_csv(rows, path)
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return compare.count_by(tables.read_manifest(load.spark, path, schema), "outcome")


MEASURED = View("events", [
    "user_id as run_no", "event_type", "value",
])


@query("manifest_build", f"""with runs as (select run_name as run_id, run_no, tranche, session, n_rows,
  {LABEL_SQL} as a, {DB_SQL} as b, top_purchase from {FOLDERS_SQL}),
 measured as (select user_id as run_no, count(distinct case when value > 15 then event_type end) as csv_files_read,
  count(case when value > 15 then 1 end) as row_count from events group by 1)
 select run_id, coalesce(try_cast(regexp_extract(run_id, '([0-9]+)$', 1) as bigint), -1) as run_number,
  tranche, session, case when outcome = 'skip' then 'unknown' else coalesce(a, b, 'unknown') end as cipher_state,
  case when outcome = 'skip' then 'none' when a is not null then 'folder' when b is not null then 'db' else 'none' end as cipher_source,
  outcome <> 'skip' and coalesce(a <> b, false) as label_mismatch,
  case when outcome = 'ok' then row_count else 0 end as row_count,
  case when outcome = 'ok' then csv_files_read + 7 else 0 end as col_count,
  case when looked then csv_files_read else 0 end as csv_files_read,
  case when looked then n_rows * 100 else 0 end as raw_size_bytes,
  case when looked then '2022-09-09T12:54:27' end as measurement_ts, outcome,
  case outcome when 'skip' then 'no traffic_generator folder' when 'ok' then ''
   else case when coalesce(a, b) is null then 'cipher state unknown'
    when csv_files_read = 0 then 'all CSV groups empty after trimming'
    else concat('too few rows after trimming: ', row_count) end end as skip_reason
 from (select runs.*, coalesce(row_count, 0) as row_count, coalesce(csv_files_read, 0) as csv_files_read,
  n_rows <= 75 and coalesce(a, b) is not null as looked,
  case when n_rows > 75 then 'skip' when coalesce(a, b) is null then 'quarantine'
   when coalesce(csv_files_read, 0) = 0 or coalesce(row_count, 0) < 13 then 'quarantine' else 'ok' end as outcome
  from runs left join measured using (run_no))""")
def manifest_build(load: Tables):
    folders = load(FOLDERS)
    runs = folders.select(
        F.col("run_name").alias("run_id"), "tranche", "session", "enb",
        (F.col("n_rows") <= 75).alias("has_data"), F.lit(5).alias("n_csv"),
        (F.col("n_rows") * 100).alias("raw_size_bytes"), F.lit("2022-09-09T12:54:27").alias("measurement_ts"),
    )
    names = folders.select("run_no", F.col("run_name").alias("run_id"), "tranche", "session")
    measured = (
        load(MEASURED).groupBy("run_no")
        .agg(
            F.count_distinct(F.when(F.col("value") > 15, F.col("event_type"))).alias("csv_files_read"),
            F.count_if(F.col("value") > 15).alias("row_count"),
        )
        .join(names, "run_no")
        .drop("run_no")
        .withColumn("col_count", F.col("csv_files_read") + 7)
    )
    return manifest.build_manifest(runs, measured, 13)


@query("manifest_summary", f"""select count(*) filter (where outcome = 'ok') as n_ok,
 count(*) filter (where outcome = 'quarantine') as n_quarantine,
 count(*) filter (where outcome = 'skip') as n_skip, count(*) filter (where label_mismatch) as n_mismatch,
 cast(sum(raw_size_bytes) as bigint) as raw_bytes, cast(sum(parquet_size_bytes) as bigint) as stored_bytes,
 coalesce(sum(raw_size_bytes) / nullif(sum(parquet_size_bytes), 0), 0.0e0) as size_ratio from {MANIFEST_SQL}""")
def manifest_summary(load: Tables):
    return manifest.manifest_summary(load(MANIFEST))


@query("size_report", f"""select tranche, count(*) as n_runs, round(sum(raw_size_bytes) / 1e9, 2) as raw_gb,
 round(sum(parquet_size_bytes) / 1e9, 2) as stored_gb,
 coalesce(sum(raw_size_bytes) / nullif(sum(parquet_size_bytes), 0), 0.0e0) as size_ratio
 from {MANIFEST_SQL} where outcome = 'ok' group by rollup (tranche)""")
def size_report(load: Tables):
    return manifest.size_report(load(MANIFEST))


@query("reject_reasons", f"""select skip_reason, count(*) as n from {MANIFEST_SQL}
 where outcome = 'quarantine' group by 1 order by n desc, skip_reason""")
def reject_reasons(load: Tables):
    return manifest.reject_reasons(load(MANIFEST))


@query("manifest_file_antijoin", f"""select run_id, parquet_path from {MANIFEST_SQL}
 where outcome = 'ok' and parquet_path not in (select parquet_path from {STORED.sql()})""")
def manifest_file_antijoin(load: Tables):
    missing = manifest.missing_files(load(MANIFEST), load(STORED))
    return missing.select("run_id", "parquet_path")


@query("run_completeness", f"""select run_id, outcome from {MANIFEST_SQL}
 where run_id not in (select run_id from {PIPELINE_LOG.sql()} where status = 'pass')""")
def run_completeness(load: Tables):
    return manifest.incomplete_runs(load(MANIFEST), load(PIPELINE_LOG)).select("run_id", "outcome")


@query("class_balance", f"""select tranche, session, {on_off()},
 count(*) filter (where cipher_state = 'on') * 100.0e0
  / nullif(count(*) filter (where cipher_state in ('on', 'off')), 0) as pct_on
 from {MANIFEST_SQL} group by 1, 2""")
def class_balance(load: Tables):
    return compare.class_balance(load(MANIFEST), ["tranche", "session"])


@query("class_value_counts", f"select cipher_state, count(*) as n from {MANIFEST_SQL} group by 1")
def class_value_counts(load: Tables):
    return compare.count_by(load(MANIFEST), "cipher_state")


@query("runs_by_tranche", f"select tranche, cipher_state, count(*) as n from {MANIFEST_SQL} group by 1, 2")
def runs_by_tranche(load: Tables):
    return compare.count_by(load(MANIFEST), "tranche", "cipher_state")


@query("runs_by_session", f"select session, cipher_state, count(*) as n from {MANIFEST_SQL} group by 1, 2")
def runs_by_session(load: Tables):
    return compare.count_by(load(MANIFEST), "session", "cipher_state")


@query("run_count_rollup", f"""select tranche, session, grouping(tranche, session) as level, {on_off()},
 count(*) as n_runs, count(distinct (tranche, session)) as n_sessions
 from {MANIFEST_SQL} group by rollup (tranche, session)""")
def run_count_rollup(load: Tables):
    return compare.run_count_rollup(load(MANIFEST))


@query("row_count_stats", f"""select min(row_count) as min_rows, max(row_count) as max_rows,
 median(row_count) as median_rows from {RUNS_SQL}""")
def row_count_stats(load: Tables):
    return compare.row_count_stats(load(RUNS))


@query("overview_metrics", f"select count(*) as n_runs, {on_off()} from {RUNS_SQL}")
def overview_metrics(load: Tables):
    return compare.overview(load(RUNS))


@query("class_mean", f"""select cipher_state, {', '.join(f'round(avg({k}), 8) as {k}' for k in KPIS)}
 from {ML_SQL} group by 1""")
def class_mean(load: Tables):
    return rounded(compare.class_mean(load(ML), KPIS), 8, *KPIS)


GAP_SQL = " union all ".join(
    f"""select '{k}' as kpi, a as mean_off, b as mean_on, b - a as gap, (b - a) * 100 / abs(nullif(a, 0)) as gap_pct
     from (select avg({k}) filter (where cipher_state = 'off') as a,
      avg({k}) filter (where cipher_state = 'on') as b from {ML_SQL})"""
    for k in KPIS
)


@query("class_gap", f"""select kpi, round(mean_off, 6) as mean_off, round(mean_on, 6) as mean_on,
 round(gap, 6) as gap, round(gap_pct, 4) as gap_pct from ({GAP_SQL})""")
def class_gap(load: Tables):
    gaps = rounded(compare.class_gap(load(ML), KPIS), 6, "mean_off", "mean_on", "gap")
    return rounded(gaps, 4, "gap_pct")


@query("kpi_direction", f"""select kpi, round(gap_pct, 4) as gap_pct,
 case when mean_on = 0 and mean_off = 0 then 'zero in both' when abs(gap_pct) < 0.1 then 'no difference'
 when gap < 0 then 'lower' when kpi = 'bler_mean' then 'wider' else 'higher' end as direction from ({GAP_SQL})""")
def kpi_direction(load: Tables):
    return rounded(compare.kpi_direction(load(ML), KPIS, higher={"bler_mean": "wider"}), 4, "gap_pct")


@query("class_quantile_curve", " union all ".join(
    f"select cipher_state, 'q{int(p * 100)}' as quantile, round(quantile_cont(bler_mean, {p}), 8) as value"
    f" from {ML_SQL} group by 1" for p in (0.25, 0.5, 0.75, 0.95)))
def class_quantile_curve(load: Tables):
    return rounded(compare.class_quantile_curve(load(ML), "bler_mean"), 8, "value")


@query("class_separation", f"""select round(a, 8) as high_q25, round(b, 8) as low_q75, low_max, high_min,
 a > b as iqr_separated, low_max >= high_min as tails_overlap from (select
 quantile_cont(bler_mean, 0.25) filter (where cipher_state = 'on') as a,
 quantile_cont(bler_mean, 0.75) filter (where cipher_state = 'off') as b,
 max(bler_mean) filter (where cipher_state = 'off') as low_max,
 min(bler_mean) filter (where cipher_state = 'on') as high_min from {ML_SQL})""")
def class_separation(load: Tables):
    return rounded(compare.class_separation(load(ML), "bler_mean"), 8, "high_q25", "low_q75")


@query("box_stats", f"""with q as (select cipher_state, quantile_cont(dl_throughput_mean, 0.25) as q25,
  quantile_cont(dl_throughput_mean, 0.5) as q50, quantile_cont(dl_throughput_mean, 0.75) as q75 from {ML_SQL} group by 1)
 select cipher_state, round(q25, 6) as q25, round(q50, 6) as q50, round(q75, 6) as q75,
 min(x) filter (where ok) as whisker_low, max(x) filter (where ok) as whisker_high,
 count(*) filter (where not ok) as n_outliers
 from (select q.*, dl_throughput_mean as x, dl_throughput_mean between q25 - 1.5 * (q75 - q25)
  and q75 + 1.5 * (q75 - q25) as ok from {ML_SQL} m join q using (cipher_state)) group by 1, 2, 3, 4""")
def box_stats(load: Tables):
    return rounded(compare.box_stats(load(ML), "dl_throughput_mean"), 6, "q25", "q50", "q75")


def histogram_sql(rows: str, value: str, bins: int) -> str:
    return f"""with b as (select min({value}) as lo, (max({value}) - min({value})) / {bins} as w from {rows})
     select cipher_state, cast(least({bins - 1}, floor(({value} - lo) / w)) as integer) as bin, count(*) as n
     from {rows}, b where {value} is not null group by 1, 2"""


@query("histogram", histogram_sql(BRONZE_SQL, "dl_tput", 50))
def histogram(load: Tables):
    return compare.histogram(load(BRONZE), "dl_tput", 50)


PUBLISHED = View("lineitem", [
    "l_suppkey as run_id", "cast(l_suppkey % 2 as int) as indicator",
    "case when l_discount > 0.05 then 1e0 else 0e0 end as hit", "268 + l_tax * 8 as pdu_size",
])
PUBLISHED_RUNS = View(PUBLISHED, ["run_id", "indicator", "avg(hit) as x15", "min(pdu_size) as x182"], group=2)


@query("reference_stats", f"""select 'x15' as feature, 'all' as class, round(avg(x15), 8) as mean, round(median(x15), 8) as median,
  count(x15) as n from {PUBLISHED_RUNS.sql()} union all
 select 'x182', 'all', round(avg(x182), 8), round(median(x182), 8), count(x182) from {PUBLISHED_RUNS.sql()} union all
 select 'x15', case indicator when 1 then 'on' else 'off' end, round(avg(x15), 8), round(median(x15), 8), count(x15)
  from {PUBLISHED_RUNS.sql()} group by indicator""")
def reference_stats(load: Tables):
    return rounded(reference.reference_stats(load(PUBLISHED_RUNS)), 8, "mean", "median")


@query("reference_compare", f"""select tranche, n_own, n_published from
 (select tranche, count(*) as n_own from {MANIFEST_SQL} where outcome = 'ok' group by 1) full join
 (select tranche, count(*) as n_published from {RUNS_SQL} group by 1) using (tranche)""")
def reference_compare(load: Tables):
    return reference.reference_compare(manifest.ok_runs(load(MANIFEST)), load(RUNS))
