"""Row positions, positional merge, run outcomes, top-k and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.labels import label_from_name, normalize_label, resolve_label
from runlens.operators import manifest, merge, quality, windows
from runlens.operators.ordinal import row_ordinal
from runlens.plans.queries.names import DB_SQL, LABEL_SQL
from runlens.plans.registry import Tables, query
from runlens.plans.views import (
    BRONZE, CATALOGUE, FOLDERS, GROUP_NAMES, GROUPS, GROUPS_MISSING, RUNS,
)

GROUPS_SQL, FOLDERS_SQL, RUNS_SQL = GROUPS.sql(), FOLDERS.sql(), RUNS.sql()

ORDINAL_SQL = """select run_id, grp, event_id, value,
 row_number() over (partition by run_id, grp order by ts, event_id) - 1 as ordinal from {}"""


@query("row_ordinal", ORDINAL_SQL.format(GROUPS_SQL))
def row_ordinal_query(load: Tables):
    placed = row_ordinal(load(GROUPS), ["run_id", "grp"], ["ts", "event_id"])
    return placed.select("run_id", "grp", "event_id", "value", "ordinal")


def _merge_sql(groups_sql: str) -> str:
    columns = ", ".join(f"max(value) filter (where grp = '{g}') as {g}__value" for g in GROUP_NAMES)
    return f"""with placed as ({ORDINAL_SQL.format(groups_sql)}),
     sizes as (select run_id, min(n) as m from (select run_id, grp, count(*) as n from placed group by 1, 2) group by 1)
     select run_id, ordinal, {columns} from placed join sizes using (run_id) where ordinal < m group by 1, 2"""


@query("positional_merge", _merge_sql(GROUPS_SQL))
def positional_merge(load: Tables):
    return merge.merge_long(load(GROUPS), ["run_id"], "grp", ["ts", "event_id"], "value", GROUP_NAMES)


@query("positional_merge_missing", _merge_sql(GROUPS_MISSING.sql()))
def positional_merge_missing(load: Tables):
    return merge.merge_long(
        load(GROUPS_MISSING), ["run_id"], "grp", ["ts", "event_id"], "value", GROUP_NAMES
    )


@query("positional_merge_frames", _merge_sql(GROUPS_MISSING.sql()))
def positional_merge_frames(load: Tables):
    groups, order = load(GROUPS_MISSING), ["ts", "event_id"]
    frames = {
        g: groups.where(F.col("grp") == g).select("run_id", *order, F.col("value").alias(f"{g}__value"))
        for g in GROUP_NAMES
    }
    return merge.merge_frames(frames, ["run_id"], order)


@query("min_rows_filter", f"""select run_id, grp, event_id from {GROUPS_SQL}
 where run_id in (select run_id from {GROUPS_SQL} group by 1 having count(*) >= 65)""")
def min_rows_filter(load: Tables):
    kept = manifest.min_rows_filter(load(GROUPS), ["run_id"], 65)
    return kept.select("run_id", "grp", "event_id")


@query("bottleneck_groups", f"""select run_id, grp, n_rows, min(n_rows) over (partition by run_id) as min_rows,
 cast(rank() over (partition by run_id order by n_rows) as integer) as shortness
 from (select run_id, grp, count(*) as n_rows from {GROUPS_SQL} group by 1, 2)""")
def bottleneck_groups(load: Tables):
    return merge.bottleneck_groups(merge.group_sizes(load(GROUPS), ["run_id"], "grp"), ["run_id"], "grp")


OUTCOME_SQL = f"""select run_name, cipher_state,
 case when not has_data then 'skip' when cipher_state = 'unknown' then 'quarantine' when n_csv = 0 then 'skip'
  when n_groups = 0 then 'quarantine' when n_rows < 60 then 'quarantine' else 'ok' end as outcome,
 case when not has_data then 'no traffic_generator folder' when cipher_state = 'unknown' then 'cipher state unknown'
  when n_csv = 0 then 'no CSV files in traffic_generator' when n_groups = 0 then 'all CSV groups empty after trimming'
  when n_rows < 60 then concat('too few rows after trimming: ', n_rows) else '' end as skip_reason
 from (select run_name, coalesce({LABEL_SQL}, {DB_SQL}, 'unknown') as cipher_state, n_rows,
  n_rows <> 70 as has_data, case when n_rows = 64 then 0 else 5 end as n_csv,
  case when n_rows = 66 then 0 else 5 end as n_groups from {FOLDERS_SQL})"""


@query("run_outcome", OUTCOME_SQL)
def run_outcome(load: Tables):
    state = resolve_label(label_from_name(F.col("run_name")), normalize_label(F.col("enb")))
    runs = load(FOLDERS).select("run_name", state["cipher_state"].alias("cipher_state"), "n_rows")
    decided = manifest.run_outcome(
        F.col("n_rows") != 70, F.col("cipher_state"),
        F.when(F.col("n_rows") == 64, 0).otherwise(5),
        F.when(F.col("n_rows") == 66, 0).otherwise(5),
        F.col("n_rows"), 60,
    )
    return runs.withColumns(decided).drop("n_rows")


@query("first_match", f"""select word, min(pos) as pos, min_by(layer_raw, pos) as layer_raw from (
 select split_part(lower(meas_key), '_', 1) as word, pos, layer_raw from {CATALOGUE.sql()}) group by 1""")
def first_match(load: Tables):
    pairs = load(CATALOGUE).selectExpr(
        "split_part(lower(meas_key), '_', 1) as word", "pos", "layer_raw"
    )
    return windows.first_match(pairs, ["word"], "pos", "layer_raw")


@query("head_per_run", f"""select run_id, event_id, place from (select run_id, event_id,
 cast(row_number() over (partition by run_id order by ts, event_id) as integer) as place
 from {GROUPS_SQL} where value is not null) where place <= 40""")
def head_per_run(load: Tables):
    known = load(GROUPS).where(F.col("value").isNotNull()).select("run_id", "ts", "event_id")
    head = windows.head_per_group(known, ["run_id"], ["ts", "event_id"], 40)
    return head.select("run_id", "event_id", "place")


@query("every_nth_run", f"""select * from (select run_id, tranche, session,
 row_number() over (order by tranche, session, run_id) as place from {RUNS_SQL}) where place % 10 = 0""")
def every_nth_run(load: Tables):
    runs = load(RUNS).select("run_id", "tranche", "session")
    return windows.every_nth(runs, ["tranche", "session", "run_id"], 10)


@query("topk_null_columns", f"""with rates as (
 {' union all '.join(f"select '{c}' as subject, avg(r) as rate from (select run_id, avg(case when {x} is null then 1.0 else 0.0 end) as r from {BRONZE.sql()} group by 1)"
   for c, x in (('bler', 'nullif(bler, 0.05)'), ('lost_pdus', 'lost_pdus'), ('mcs', 'nullif(mcs, 7.0)'), ('snr', 'dl_tput')))})
 select subject, round(rate, 9) as observed from rates where rate > 0.01 order by observed desc, subject limit 10""")
def topk_null_columns(load: Tables):
    df = load(BRONZE).selectExpr(
        "run_id", "nullif(bler, 0.05) as bler", "lost_pdus", "nullif(mcs, 7.0) as mcs", "dl_tput as snr"
    )
    worst = quality.worst_null_columns(quality.null_rates(df, fragments=("bler", "lost_pdu", "mcs", "snr")))
    return worst.withColumn("observed", F.round("observed", 9))


@query("union_by_name", f"""select run_id, 'wide' as part, bler, mcs, cast(null as double) as retx, l_linenumber + 0.0e0 as line
 from {BRONZE.sql()} where cipher_state = 'on' union all
 select run_id, 'narrow', bler, null, retx, l_linenumber * 0.5e0 from {BRONZE.sql()} where cipher_state = 'off'""")
def union_by_name(load: Tables):
    df = load(BRONZE)
    on = df.where("cipher_state = 'on'").selectExpr(
        "run_id", "'wide' as part", "bler", "mcs", "l_linenumber as line"
    )
    off = df.where("cipher_state = 'off'").selectExpr(
        "l_linenumber * 0.5e0 as line", "retx", "bler", "'narrow' as part", "run_id"
    )
    return windows.stack_by_name([on, off])


@query("union_outliers", f"""select run_id, row_count, 'low' as kind from {RUNS_SQL} where row_count < 570
 union all select run_id, row_count, 'high' from {RUNS_SQL} where row_count > 630""")
def union_outliers(load: Tables):
    tests = [("low", F.col("row_count") < 570), ("high", F.col("row_count") > 630)]
    return windows.either(load(RUNS), tests).select("run_id", "row_count", "kind")
