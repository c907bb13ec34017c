"""Sources and sinks: Spark writes files from the tables, and the readers read them back."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.constants import CATALOGUE_HEADERS, SHEETS
from runlens.operators import catalogue, manifest, quality, silver
from runlens.operators.ordinal import split_places
from runlens.plans.ingest import ingest, ingest_to
from runlens.plans.queries.catalogue import feature_measurand_join
from runlens.plans.queries.measurements import silver_sql
from runlens.plans.queries.names import DB_SQL, LABEL_SQL
from runlens.plans.registry import QUERIES, Tables, query
from runlens.plans.views import (
    CATALOGUE, FEATURES, FOLDERS, MANIFEST, NATIVE, STORED, View,
)
from runlens.session import scratch_path, stored
from runlens.sources import csv_groups, csv_ranges, files, label_db, tables, versions

FOLDERS_SQL, NATIVE_SQL = FOLDERS.sql(), NATIVE.sql()

# Raw rows: a run's events, one CSV group per event type.
RAW = View("events", [
    "user_id as run_no", "event_id", "ts", "value",
    "case event_type when 'click' then 'UECOMBINED_MACRXSTATS_ALL'"
    " when 'view' then 'UECOMBINED_L1CARRIERPOWERS' when 'error' then 'UECOMBINED_PDCPRXSTATS_ALL'"
    " when 'signup' then 'UECOMBINED_RLCRXSTATS_ALL' else 'UECOMBINED_MACTXSTATS_ALL' end as grp",
])
TAGS = ("mac_rx", "l1_powers", "pdcp_rx", "rlc_rx", "mac_tx")
TAG_SQL = """case event_type when 'click' then 'mac_rx' when 'view' then 'l1_powers' when 'error' then 'pdcp_rx'
 when 'signup' then 'rlc_rx' else 'mac_tx' end"""
MEASUREMENTS = ("mean value", "event id")


def _written(load: Tables, name: str, write) -> str:
    """Write a file set for one query."""
    path = scratch_path(load.spark, name)
    write(path)
    return path


def write_lines(rows: DataFrame, order: list[str], root: str) -> None:
    """Write a CSV per folder and task: ``rows`` holds folder, header and line, and the columns in ``order``. The tasks make the folders.

    Rows are range-partitioned, so a huge folder becomes several part files in order. A task that is run again writes the same names.
    """
    base = files.root_uri(rows.sparkSession, root)

    def write(batches):
        at, out = None, None
        for batch in batches:
            for folder, own in batch.groupby("folder", sort=False):
                if folder != at:
                    if out:
                        out.close()
                    filesystem, path = files.located(f"{base}{folder}")
                    filesystem.create_dir(path)
                    out = filesystem.open_output_stream(f"{path}/part-{TaskContext.get().partitionId():05d}.csv")
                    out.write(f"{own['header'].iloc[0]}\n".encode())
                    at = folder
                out.write("".join(f"{line}\n" for line in own["line"]).encode())
            yield batch[["folder"]].iloc[:0]
        if out:
            out.close()

    spread = rows.repartitionByRange(files.n_tasks(rows.sparkSession), "folder", *order).sortWithinPartitions("folder", *order)
    spread.select("folder", "header", "line").mapInPandas(write, "folder string").write.format("noop").mode("overwrite").save()


def raw_tree(load: Tables) -> str:
    """A raw tree in which on and off runs have different headers."""
    folders = load(FOLDERS).select(
        "run_no", "tranche", "session", F.col("run_name").alias("run_id"),
        F.substring("file_stem", 1, 13).alias("prefix"),
    )
    cells = {
        "Time us": F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"), "Mean Value": F.col("value"),
        "Event ID": F.col("event_id"), "Note": F.lit("x"),
    }
    upper = F.lower("run_id").startswith("cipheron")
    layouts = {
        True: ["Time us", "Mean Value", "Event ID"],
        False: ["Note", "Event ID", "Mean Value", "Time us"],
    }
    lines = {on: F.concat_ws(",", *[F.coalesce(cells[c].cast("string"), F.lit("")) for c in names]) for on, names in layouts.items()}
    keys = {"tranche": F.col("tranche"), "session": F.col("session"), "run_id": F.col("run_id"), "file": F.concat_ws("_", "prefix", "grp")}
    rows = load(RAW).join(folders, "run_no").select(
        F.concat_ws("/", *[F.concat(F.lit(f"{k}="), v) for k, v in keys.items()]).alias("folder"),
        F.when(upper, ",".join(layouts[True])).otherwise(",".join(layouts[False])).alias("header"),
        F.when(upper, lines[True]).otherwise(lines[False]).alias("line"),
        cells["Time us"].alias("us"), "event_id",
    )
    return _written(load, "raw", lambda path: write_lines(rows, ["us", "event_id"], path))


@query("src_run_tree", f"""select f.tranche, f.session, f.run_name as run_id, {TAG_SQL} as tag
 from events e join {FOLDERS_SQL} f on f.run_no = e.user_id group by 1, 2, 3, 4""")
def src_run_tree(load: Tables):
    tree = files.run_tree(files.list_files(load.spark, raw_tree(load), "*.csv"))
    return tree.select("tranche", "session", "run_id", "tag").distinct()


@query("src_run_sizes", f"""select f.tranche, f.session, f.run_name as run_id, true as has_data, true as has_bytes,
 '20' || substr(f.file_stem, 1, 2) || '-' || substr(f.file_stem, 3, 2) || '-' || substr(f.file_stem, 5, 2)
 || 'T' || substr(f.file_stem, 8, 2) || ':' || substr(f.file_stem, 10, 2) || ':' || substr(f.file_stem, 12, 2)
 as measurement_ts from {FOLDERS_SQL} f""")
def src_run_sizes(load: Tables):
    """Byte counts depend on the writer, so the comparison is on what does not."""
    sizes = files.run_sizes(files.run_tree(files.list_files(load.spark, raw_tree(load), "*.csv")))
    return sizes.select(
        "tranche", "session", "run_id", "has_data", (F.col("raw_size_bytes") > 0).alias("has_bytes"),
        "measurement_ts",
    )


def folder_tree(load: Tables) -> str:
    """A raw tree with runs that hold nothing, an empty data folder, foreign files only, one CSV or two; the tasks make it.

    A CSV has a header and a line per event of its run, two bytes each.
    """
    root = scratch_path(load.spark, "folders")
    base = files.root_uri(load.spark, root)

    def build(batches):
        for batch in batches:
            for r in batch.itertuples():
                run = f"{base}{r.tranche}/{r.session}/{r.run_name}"
                data, lines = f"{run}/traffic_generator", "Mean Value\n" + "1\n" * r.n_rows
                own, second = f"{r.file_stem}.csv", f"{r.file_stem[:13]}_UECOMBINED_MACRXSTATS_ALL.csv"
                made = [
                    {run: {}}, {data: {}}, {run: {"notes.csv": lines}}, {data: {"notes.txt": lines}},
                    {data: {own: lines, ".hidden.csv": lines}, f"{run}/extra/deep": {own: lines}}, {data: {own: lines, second: lines}},
                ][r.run_no % 6]
                for folder, contents in made.items():
                    filesystem, path = files.located(folder)
                    filesystem.create_dir(path)
                    for name, text in contents.items():
                        with filesystem.open_output_stream(f"{path}/{name}") as out:
                            out.write(text.encode())
            yield batch[["run_no"]]

    load(FOLDERS).select("run_no", "tranche", "session", "run_name", "file_stem", "n_rows").mapInPandas(build, "run_no long").write.format("noop").mode("overwrite").save()
    return root


KIND = "run_no % 6"
N_CSV_SQL = f"case {KIND} when 4 then 1 when 5 then 2 else 0 end"


@query("src_run_folders", f"""select tranche, session, run_name as run_id, {KIND} not in (0, 2) as has_data,
 cast({N_CSV_SQL} as bigint) as n_csv, cast({N_CSV_SQL} * (11 + 2 * n_rows) as bigint) as raw_size_bytes,
 case when {KIND} >= 4 then {{stamp}} end as measurement_ts from {FOLDERS_SQL} f""".replace("{stamp}", """'20' || substr(f.file_stem, 1, 2) || '-'
 || substr(f.file_stem, 3, 2) || '-' || substr(f.file_stem, 5, 2) || 'T' || substr(f.file_stem, 8, 2) || ':' || substr(f.file_stem, 10, 2)
 || ':' || substr(f.file_stem, 12, 2)"""))
def src_run_folders(load: Tables):
    """All run folders, empty ones too, with the bytes of their CSVs."""
    sizes = files.run_sizes(files.run_tree(files.walk(load.spark, folder_tree(load), files.within_runs)))
    return sizes.select("tranche", "session", "run_id", "has_data", "n_csv", F.col("raw_size_bytes").cast("bigint"), "measurement_ts")


@query("src_folder_counts", f"""select tranche, session, count(distinct run_name) filter (where lower(run_name) like '%cipheron%') as n_on,
 count(distinct run_name) filter (where lower(run_name) like '%cipheroff%') as n_off from {FOLDERS_SQL} group by 1, 2""")
def src_folder_counts(load: Tables):
    """The census counts run folders, whether or not anything is in them."""
    tree = files.run_tree(files.walk(load.spark, folder_tree(load), files.within_runs))
    return manifest.run_census(tree, "run_id", "grp").drop("groups")


def _columns() -> dict[str, tuple[str, ...]]:
    return {tag: MEASUREMENTS for tag in TAGS}


def _read(load: Tables) -> DataFrame:
    root = raw_tree(load)
    tree = files.run_tree(files.list_files(load.spark, root, "*.csv"))
    headers = files.csv_headers(tree)
    return csv_groups.read_groups(load.spark, root, tree, headers, _columns(), partitioned=True)


PLACED_SQL = f"""(select f.tranche, f.session, f.run_name as run_id, {TAG_SQL} as tag, value, event_id, epoch_us(ts) as us,
 row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as ordinal
 from events e join {FOLDERS_SQL} f on f.run_no = e.user_id)"""


@query("src_group_csv", f"""select run_id, tag, ordinal, value as mean_value, cast(event_id as double) as event_id
 from {PLACED_SQL}""")
def src_group_csv(load: Tables):
    placed = split_places(stored(_read(load), "rows"), csv_groups.FILE, csv_groups.SPLIT, csv_groups.LINE)
    return placed.select(
        "run_id", "tag", "ordinal",
        F.col("values")[0].alias("mean_value"), F.col("values")[1].alias("event_id"),
    )


@query("src_csv_ranges", """select doc_id, cast(length(text) as bigint) as n_letters, md5(text) as digest,
 row_number() over (order by doc_id) - 1 as place from documents""")
def src_csv_ranges(load: Tables):
    """Texts with quotes and line breaks, in files that are cut into ranges of 64 KB; places go on over the files."""
    path = scratch_path(load.spark, "texts")
    texts = load("documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    texts.write.options(header="true", escape='"', quoteAll="true", **kept).csv(path)
    rows = stored(csv_ranges.read_ranges(files.list_files(load.spark, path, "*.csv"), 2, 1 << 16), "ranges")
    placed = split_places(rows.withColumn("all", F.lit(1)), ["all"], csv_groups.SPLIT, csv_groups.LINE, "place")
    text = F.col("cells")[1]
    return placed.select(
        F.col("cells")[0].cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_letters"), F.md5(text).alias("digest"), "place"
    )


MARGIN_US = 86_400_000_000
TRIMMED_SQL = f"""(select *, row_number() over (partition by run_id, tag order by us, event_id) - 1 as place from (select *,
 min(us) over (partition by run_id, tag) as a, max(us) over (partition by run_id, tag) as b from {PLACED_SQL})
 where us between a + {MARGIN_US} and b - {MARGIN_US})"""
LABELLED_SQL = f"""(select run_name as run_id, coalesce({LABEL_SQL}, {DB_SQL}, 'unknown') as cipher_state from {FOLDERS_SQL})"""


def _labels(load: Tables) -> DataFrame:
    return load(FOLDERS).select("tranche", "session", F.col("run_name").alias("name"), "enb")


@query("ingest_bronze", f"""with s as (select run_id, min(n) as m from (select run_id, tag, count(*) as n
  from {TRIMMED_SQL} group by 1, 2) group by 1)
 select run_id, cipher_state, place as ordinal, {', '.join(
  f"max(value) filter (where tag = '{t}') as {t}__mean_value" for t in TAGS)}
 from {TRIMMED_SQL} join s using (run_id) join {LABELLED_SQL} using (run_id)
 where place < m and m >= 5 and cipher_state <> 'unknown' group by 1, 2, 3""")
def ingest_bronze(load: Tables):
    done = ingest(load.spark, raw_tree(load), _columns(), _labels(load), MARGIN_US, 5, partitioned=True)
    return done.bronze.select("run_id", "cipher_state", "ordinal", *[f"{t}__mean_value" for t in TAGS])


@query("ingest_manifest", f"""select run_id, outcome, count(*) as n from (select run_name as run_id,
 case when cipher_state = 'unknown' or coalesce(m, 0) < 5 then 'quarantine' else 'ok' end as outcome from {FOLDERS_SQL} f
 join {LABELLED_SQL} l on l.run_id = f.run_name left join (select run_id, min(n) as m from (select run_id, tag, count(*) as n
 from {TRIMMED_SQL} group by 1, 2) group by 1) s on s.run_id = f.run_name) group by 1, 2""")
def ingest_manifest(load: Tables):
    done = ingest(load.spark, raw_tree(load), _columns(), _labels(load), MARGIN_US, 5, partitioned=True)
    return done.manifest.groupBy("run_id", "outcome").agg(F.count("*").alias("n"))


@query("ingest_empty_folders", f"""select run_name as run_id, outcome, cipher_state, case outcome when 'ok' then '' else reason end as skip_reason,
 case when outcome = 'ok' then n_rows - 2 * cut else 0 end as row_count,
 case when cipher_state <> 'unknown' and {KIND} >= 4 then cast({N_CSV_SQL} * (11 + 2 * n_rows) as bigint) else 0 end as raw_size_bytes
 from (select *, case when {KIND} in (0, 2) then 'skip' when cipher_state = 'unknown' then 'quarantine'
   when {KIND} < 4 then 'skip' when n_rows - 2 * cut < 60 then 'quarantine' else 'ok' end as outcome,
  case when {KIND} in (0, 2) then 'no traffic_generator folder' when cipher_state = 'unknown' then 'cipher state unknown'
   when {KIND} < 4 then 'no CSV files in traffic_generator'
   else concat('too few rows after trimming: ', n_rows - 2 * cut) end as reason
  from (select run_no, run_name, n_rows, case when {KIND} in (0, 2) then 'unknown' else coalesce({LABEL_SQL}, {DB_SQL}, 'unknown') end as cipher_state,
   case when n_rows > 2 * least(50, greatest(1, n_rows // 20)) then least(50, greatest(1, n_rows // 20)) else 0 end as cut from {FOLDERS_SQL}))""")
def ingest_empty_folders(load: Tables):
    """The manifest has a row for every run folder."""
    done = ingest(load.spark, folder_tree(load), None, _labels(load), min_rows=60)
    return done.manifest.select("run_id", "outcome", "cipher_state", "skip_reason", "row_count", "raw_size_bytes")


TRIMMED_SIZES_SQL = f"(select run_id, tag, count(*) as n from {TRIMMED_SQL} group by 1, 2)"
ALL_NAMES = ("time_us", "mean_value", "event_id")


@query("ingest_all_columns", f"""with s as (select run_id, min(n) as m from {TRIMMED_SIZES_SQL} group by 1)
 select run_id, cipher_state, place as ordinal, {', '.join(
  f"max({v}) filter (where tag = '{t}') as {t}__{c}" for t in TAGS
  for c, v in zip(ALL_NAMES, ('cast(us as double)', 'value', 'cast(event_id as double)'), strict=True))},
 {', '.join(f"cast(null as double) as {t}__note" for t in TAGS)}
 from {TRIMMED_SQL} join s using (run_id) join {LABELLED_SQL} using (run_id)
 where place < m and m >= 5 and cipher_state <> 'unknown' group by 1, 2, 3""")
def ingest_all_columns(load: Tables):
    """Off runs have a column more; it holds text, and is null as a measurement."""
    done = ingest(load.spark, raw_tree(load), None, _labels(load), MARGIN_US, 5, partitioned=True)
    names = [f"{t}__{c}" for c in (*ALL_NAMES, "note") for t in TAGS]
    return done.bronze.select("run_id", "cipher_state", "ordinal", *names)


STAMP_SQL = """'20' || substr(f.file_stem, 1, 2) || '-' || substr(f.file_stem, 3, 2) || '-' || substr(f.file_stem, 5, 2)
 || 'T' || substr(f.file_stem, 8, 2) || ':' || substr(f.file_stem, 10, 2) || ':' || substr(f.file_stem, 12, 2)"""


@query("ingest_stored_manifest", f"""with s as (select run_id, min(n) as m, count(*) as k from {TRIMMED_SIZES_SQL} group by 1),
 l as (select run_name as run_id, {LABEL_SQL} as a, {DB_SQL} as b from {FOLDERS_SQL}),
 r as (select f.run_name as run_id, tranche, session, {STAMP_SQL} as stamp, coalesce(m, 0) as m, coalesce(k, 0) as k, a, b,
  coalesce(a, b) is not null as looked,
  case when coalesce(a, b) is null or coalesce(m, 0) < 5 then 'quarantine' else 'ok' end as outcome
  from {FOLDERS_SQL} f join l on l.run_id = f.run_name left join s on s.run_id = f.run_name)
 select run_id, coalesce(try_cast(regexp_extract(run_id, '([0-9]+)$', 1) as bigint), -1) as run_number, tranche, session,
 coalesce(a, b, 'unknown') as cipher_state, case when a is not null then 'folder' when b is not null then 'db' else 'none' end
 as cipher_source, coalesce(a <> b, false) as label_mismatch, case when looked then stamp end as measurement_ts,
 case when outcome = 'ok' then m else 0 end as row_count,
 case when outcome = 'ok' then k * case when lower(run_id) like 'cipheron%' then 3 else 4 end + 7 else 0 end as col_count,
 case when looked then k else 0 end as csv_files_read, looked as has_bytes, outcome = 'ok' as is_stored, outcome,
 case when outcome = 'ok' then '' when not looked then 'cipher state unknown' when k = 0 then 'all CSV groups empty after trimming'
  else concat('too few rows after trimming: ', m) end as skip_reason, outcome = 'quarantine' as in_quarantine from r""")
def ingest_stored_manifest(load: Tables):
    """Ingest, store, list what was stored, and read manifest and quarantine back."""
    out = scratch_path(load.spark, "ingested")
    final = ingest_to(
        load.spark, raw_tree(load), out, labels=_labels(load), trim_seconds=MARGIN_US, min_rows=5, partitioned=True
    )
    rejected = load.spark.read.parquet(f"{out}/quarantine").select(F.col("run_id").alias("q"))
    return final.join(rejected, F.col("run_id") == F.col("q"), "left").select(
        "run_id", "run_number", "tranche", "session", "cipher_state", "cipher_source", "label_mismatch", "measurement_ts",
        "row_count", "col_count", "csv_files_read", (F.col("raw_size_bytes") > 0).alias("has_bytes"),
        ((F.col("parquet_size_bytes") > 0) & (F.col("parquet_path") != "")).alias("is_stored"), "outcome", "skip_reason",
        F.col("q").isNotNull().alias("in_quarantine"),
    )


def _session_files(load: Tables) -> DataFrame:
    """A label file per (tranche, session); a session has a dozen runs by construction."""
    def build(pdf):
        import sqlite3

        import pandas as pd

        con = sqlite3.connect(":memory:")
        con.execute("create table configurations (id integer primary key, name text, eNB text)")
        pairs = pdf.sort_values("name")[["name", "enb"]].astype(object)
        con.executemany(
            "insert into configurations (name, eNB) values (?, ?)",
            pairs.where(pairs.notna(), None).itertuples(index=False, name=None),
        )
        con.commit()
        first = pdf.iloc[0]
        content = bytes(con.serialize())
        return pd.DataFrame([(first["tranche"], first["session"], content)],
                            columns=["tranche", "session", "content"])

    return _labels(load).groupBy("tranche", "session").applyInPandas(
        build, "tranche string, session string, content binary"
    )


@query("src_label_db", f"select tranche, session, run_name as name, enb from {FOLDERS_SQL}")
def src_label_db(load: Tables):
    return label_db.label_table(_session_files(load))


# --- stored tables --------------------------------------------------------------------


MIXED = "l1_dl_carrier__retransmission_0"


def bronze_files(load: Tables) -> str:
    """Bronze in which one column is an integer in some files and a float in others."""
    def write(path: str) -> None:
        rows = load(NATIVE).withColumn("measurement_ts", F.col("measurement_ts").cast("string"))
        rows = rows.withColumns({
            "run_number": F.col("run_id"), "run_id": F.col("run_id").cast("string"),
            "label_mismatch": F.lit(False),
        })
        on, off = F.col("cipher_state") == "on", F.col("cipher_state") == "off"
        tables.write_bronze(rows.where(on).withColumn(MIXED, F.col(MIXED).cast("int")), f"{path}/on")
        tables.write_bronze(rows.where(off).withColumn(MIXED, F.col(MIXED).cast("float")), f"{path}/off")

    return _written(load, "bronze", write)


MEASURED = ("l1_dl_carrier__dl_sch_bler", "l1_dl_carrier__retransmission_0", "rlc_rx__lost_pdus")
BRONZE_READ_SQL = f"""select cast(run_id as varchar) as run_id, cipher_state, tranche, session,
 {', '.join(MEASURED)} from {NATIVE_SQL}"""


def _bronze(load: Tables) -> DataFrame:
    path = bronze_files(load)
    frames = [
        tables.read_bronze(load.spark, f"{path}/{part}", tables.bronze_schema(MEASURED))
        for part in ("on", "off")
    ]
    return frames[0].unionByName(frames[1])


@query("src_bronze", BRONZE_READ_SQL)
def src_bronze(load: Tables):
    return _bronze(load).select("run_id", "cipher_state", "tranche", "session", *MEASURED)


@query("sink_bronze", f"""select tranche, session, cast(run_id as varchar) as run_id, count(*) as n
 from {NATIVE_SQL} group by 1, 2, 3""")
def sink_bronze(load: Tables):
    return _bronze(load).groupBy("tranche", "session", "run_id").agg(F.count("*").alias("n"))


def _footers(load: Tables) -> DataFrame:
    return files.footer_columns(files.list_files(load.spark, bronze_files(load), "*.parquet"))


# What the footers must hold: the native columns, the identity, and the mixed column.
_KINDS = {
    **{c.rsplit(" as ", 1)[1]: "double" for c in NATIVE.columns if "__" in c},
    "run_id": "string", "cipher_state": "string", "measurement_ts": "string",
    "run_number": "int64", "label_mismatch": "bool",
}
N_COLUMNS = len(_KINDS)
_PAIRS = [(c, k) for c, k in _KINDS.items() if c != MIXED] + [(MIXED, "int32"), (MIXED, "float")]
PAIRS_SQL = f"(values {', '.join(f"('{c}', '{k}')" for c, k in _PAIRS)}) k(\"column\", type)"
TRANCHES_SQL = f"(select tranche, count(*) as n from {NATIVE_SQL} group by 1)"


@query("src_footer_schema", f"""select t.tranche, k."column", k.type, cast(null as varchar) as error
 from {TRANCHES_SQL} t cross join {PAIRS_SQL}""")
def src_footer_schema(load: Tables):
    return _footers(load).select("tranche", "column", "type", "error").distinct()


def _file_results(results: DataFrame) -> DataFrame:
    """File names are the writer's, so files are told apart by their findings only."""
    return results.drop("subject").distinct()


@query("dq_boolean_columns", f"""select distinct 'boolean_columns' as check_id, 'file' as scope, 0.0e0 as observed,
 '0' as expected, 'PASS' as status, 'FAIL' as severity from {TRANCHES_SQL}""")
def dq_boolean_columns(load: Tables):
    return _file_results(quality.boolean_columns(_footers(load)))


@query("dq_column_counts", f"""select tranche, cast({N_COLUMNS} as bigint) as least, cast({N_COLUMNS} as bigint) as most,
 cast(1 as bigint) as n_counts from {TRANCHES_SQL}""")
def dq_column_counts(load: Tables):
    return quality.column_counts(_footers(load))


@query("dq_readable", f"""select distinct 'readable' as check_id, 'file' as scope, 0.0e0 as observed,
 'opens' as expected, 'PASS' as status, 'FAIL' as severity from {TRANCHES_SQL}""")
def dq_readable(load: Tables):
    return _file_results(quality.readable(_footers(load)))


@query("val_files_present", f"""select 'files_present' as check_id, 'dataset' as scope, kind as subject,
 cast(n as double) as observed, '0' as expected, case when n = 0 then 'PASS' else 'FAIL' end as status,
 'FAIL' as severity from (select 'missing' as kind, count(*) as n from {MANIFEST.sql()} where outcome = 'ok'
  and parquet_path not in (select parquet_path from {STORED.sql()}) union all select 'unreadable', 0)""")
def val_files_present(load: Tables):
    missing = manifest.missing_files(load(MANIFEST), load(STORED))
    return quality.files_present(missing, _footers(load))


@query("val_schema_uniform", f"""select 'schema_uniform' as check_id, 'tranche' as scope, tranche as subject,
 1.0e0 as observed, '<= 1' as expected, 'PASS' as status, 'WARN' as severity from {TRANCHES_SQL}""")
def val_schema_uniform(load: Tables):
    return quality.schema_uniform(_footers(load))


@query("distinct_schemas", f"select tranche, cast(1 as bigint) as n_schemas from {TRANCHES_SQL}")
def distinct_schemas(load: Tables):
    return quality.distinct_schemas(_footers(load))


@query("find_dtype_conflicts", f"""select distinct '{MIXED}' as "column", 'int32' as type from {TRANCHES_SQL}""")
def find_dtype_conflicts(load: Tables):
    return quality.dtype_conflicts(_footers(load)).select("column", "type").distinct()


@query("mixed_types", f"""select distinct '{MIXED}' as "column", cast(2 as bigint) as n_types from {TRANCHES_SQL}""")
def mixed_types(load: Tables):
    return quality.mixed_types(_footers(load)).select("column", "n_types")


@query("sink_silver", silver_sql())
def sink_silver(load: Tables):
    path = scratch_path(load.spark, "silver")
    tables.write_table(silver.run_features(silver.gathered(load(NATIVE))), path)
    return load.spark.read.parquet(path)


@query("sink_versions", f"""select 1 as number, {', '.join(MEASURED)} from {NATIVE_SQL} where run_id % 2 = 0
 union all select 2, {', '.join(MEASURED)} from {NATIVE_SQL}""")
def sink_versions(load: Tables):
    """Two versions of one table: half of the runs, then all of them."""
    path, rows = scratch_path(load.spark, "versions"), load(NATIVE)
    versions.replace(tables.bronze_rows(rows.where("run_id % 2 = 0")), path, tables.bronze_writer())
    versions.append(tables.bronze_rows(rows.where("run_id % 2 = 1")), path, tables.bronze_writer())
    parts = [versions.read(load.spark, path, rows.schema, n).select(F.lit(n).alias("number"), *MEASURED) for n in (1, 2)]
    return parts[0].unionByName(parts[1])


REPAIRED_SQL = f"""select cast(run_id as varchar) as run_id, cast({MIXED} as double) as {MIXED}, rlc_rx__lost_pdus from {NATIVE_SQL}"""


@query("repair_types", f"""select run_id, {MIXED}, rlc_rx__lost_pdus, cast(1 as bigint) as n_types, true as others_kept from ({REPAIRED_SQL})""")
def repair_types(load: Tables):
    """Files in which a column is an integer are written again, the others stay; then the table has one type."""
    path, rows = scratch_path(load.spark, "repaired"), load(NATIVE).withColumn("run_id", F.col("run_id").cast("string"))
    whole = rows.where("cipher_state = 'on'").withColumn(MIXED, F.col(MIXED).cast("int"))
    versions.replace(tables.bronze_rows(whole), path, tables.bronze_writer())
    versions.append(tables.bronze_rows(rows.where("cipher_state = 'off'")), path, tables.bronze_writer())
    before = versions.files(load.spark, path)
    odd = stored(versions.conflicting(files.footer_columns(before), [MIXED]), "odd")
    versions.rewrite(load.spark, path, odd, versions.cast_columns({MIXED: "double"}), tables.bronze_writer())
    after = versions.files(load.spark, path)
    types = files.footer_columns(after).where(F.col("column") == MIXED).agg(F.count_distinct("type")).scalar()
    kept = before.join(odd, "uri", "left_anti").join(after, "uri", "left_anti").agg(F.count("*") == 0).scalar()
    found = versions.read(load.spark, path, rows.schema)
    return found.select("run_id", MIXED, "rlc_rx__lost_pdus", types.alias("n_types"), kept.alias("others_kept"))


@query("sink_manifest", f"select * from {MANIFEST.sql()}")
def sink_manifest(load: Tables):
    path = scratch_path(load.spark, "manifest")
    rows = load(MANIFEST)
    tables.write_csv(rows, path)
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return tables.read_manifest(load.spark, path, schema)


@query("sink_catalogue", QUERIES["feature_measurand_join"].sql)
def sink_catalogue(load: Tables):
    path = scratch_path(load.spark, "catalogue")
    tables.write_csv(feature_measurand_join(load), path)
    exported = tables.read_text_table(load.spark, path)
    numbers = {"priority": "bigint", "min_value": "double", "max_value": "double"}
    return exported.fillna("", ["layer_raw", "key_type", "data_type"]).withColumns({c: F.col(c).cast(t) for c, t in numbers.items()})


@query("sink_measurands", QUERIES["catalogue_project"].sql)
def sink_measurands(load: Tables):
    """The catalogue with its layer groups, exported and read back."""
    path = scratch_path(load.spark, "measurands-export")
    tables.write_csv(catalogue.catalogue_rows(load(CATALOGUE)), path)
    kinds = {"priority": "bigint", "min_value": "double", "max_value": "double"}
    exported = load.spark.read.option("header", "true").csv(path)
    return exported.fillna("").withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


@query("src_measurand_sheets", f"""select 'utg' as sheet, pos, nullif(layer_raw, '') as layer_raw, meas_key, cast(priority as bigint) as priority, min_value,
  description as text from {CATALOGUE.sql()}
 union all select 'defs', pos, null, upper(key_type), null, null, concat('Line one of ', key_type, chr(10), '"line" two') from {CATALOGUE.sql()} where pos % 2 = 0
 union all select 'net', pos, null, ue_logging, null, max_value, null from {CATALOGUE.sql()} where ue_logging is not null""")
def src_measurand_sheets(load: Tables):
    """Three sheets with different headers, with blank rows and columns without a name, read as one folder."""
    folder, rows = scratch_path(load.spark, "sheets"), load(CATALOGUE)
    short = {name: header for header, name in CATALOGUE_HEADERS.items()}
    exported = {
        "utg": rows.select("pos", *[F.nullif(c, F.lit("")).alias(h) if c == "layer_raw" else F.col(c).alias(h) for c, h in short.items()]),
        "defs": rows.where("pos % 2 = 0").select(
            F.col("pos").alias("Number"), F.upper("key_type").alias("Term"),
            F.concat(F.lit("Line one of "), "key_type", F.lit('\n"line" two')).alias("Meaning, in words"),
        ),
        "net": rows.where("ue_logging is not null").select(F.col("pos").alias("No."), F.col("ue_logging").alias("Protocol Item"), F.col("max_value").alias("Upper Bound")),
    }
    for key, sheet in exported.items():
        named = sheet.withColumn(" ", F.lit(None).cast("string"))
        blank = named.select(*[F.lit(None).cast(t).alias(c) for c, t in named.dtypes])
        named.union(blank).write.options(header="true", escape='"').csv(f"{folder}/{SHEETS[key]}.csv")
    sheets = tables.read_sheets(load.spark, folder)
    none = F.lit(None)
    utg = tables.named_catalogue(sheets["utg"]).select(F.lit("utg").alias("sheet"), "pos", "layer_raw", "meas_key", "priority", "min_value", F.col("description").alias("text"))
    defs = sheets["defs"].select(
        F.lit("defs"), F.col("Number").cast("bigint"), none.cast("string"), "Term", none.cast("bigint"), none.cast("double"), F.col("`Meaning, in words`"),
    )
    net = sheets["net"].select(
        F.lit("net"), F.col("`No.`").cast("bigint"), none.cast("string"), F.col("`Protocol Item`"), none.cast("bigint"), F.col("`Upper Bound`").cast("double"), none.cast("string"),
    )
    return utg.union(defs).union(net)


@query("src_variable_key", f"select new_var_num, orig_var_name from {FEATURES.sql()}")
def src_variable_key(load: Tables):
    path = scratch_path(load.spark, "variable-key")
    padded = load(FEATURES).select(*[
        F.concat(F.lit("  "), c, F.lit(" ")).alias(c) for c in ("new_var_num", "orig_var_name")
    ])
    padded.write.options(
        header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)
    return tables.read_text_table(load.spark, path)


@query("src_measurands", f"""select cast(pos as varchar) as pos, nullif(layer_raw, '') as layer_raw, ue_logging, meas_key
 from {CATALOGUE.sql()}""")
def src_measurands(load: Tables):
    path = scratch_path(load.spark, "measurands")
    rows = load(CATALOGUE).select(
        "pos", F.nullif("layer_raw", F.lit("")).alias("layer_raw"), "ue_logging", "meas_key",
        F.lit(None).cast("string").alias(" "),
    )
    blank = rows.select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    rows.unionByName(blank).write.option("header", "true").csv(path)
    return tables.read_catalogue(load.spark, path)


@query("src_reference_features", """select cast(l_suppkey as varchar) as run, max(l_discount) as x15,
 min(l_tax) as x182, cast(l_suppkey % 2 as double) as indicator from lineitem group by l_suppkey""")
def src_reference_features(load: Tables):
    path = scratch_path(load.spark, "published")
    runs = load("lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.max("l_discount").alias("x15"), F.min("l_tax").alias("x182")
    )
    tables.write_csv(runs.withColumn("indicator", F.col("run") % 2), path)
    return tables.read_published(load.spark, path)
