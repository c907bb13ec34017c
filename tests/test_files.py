"""Raw trees in the native layout, written by hand."""

import sqlite3

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runlens.operators import quality
from runlens.operators.manifest import RUN
from runlens.operators.merge import merge_long
from runlens.plans.ingest import finish_manifest, ingest, ingest_to
from runlens.session import stored
from runlens.sources import csv_groups, files, label_db, tables, versions

MAC, PDCP = "UECOMBINED_MACRXSTATS_ALL", "UECOMBINED_PDCPRXSTATS_ALL"
COLUMNS = {"mac_rx": ["PDU Size", "SNR (dB)"], "pdcp_rx": ["Lost PDUs"]}


def write_run(root, session, run, groups, data_folder=True):
    folder = root / "Tranche_A" / session / run
    if data_folder:
        folder = folder / "traffic_generator"
    folder.mkdir(parents=True)
    for name, lines in groups.items():
        (folder / name).write_text("".join(line + "\n" for line in lines))


def timed(n, header="Time (s),PDU Size,SNR (dB)", row="{i},{v},{w}"):
    return [header, *[row.format(i=i, v=100 + i, w=i / 2) for i in range(n)]]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw tree+1")
    mac, pdcp = f"220909_125427_{MAC}.csv", f"220909_125427_{PDCP}.csv"
    lost = ["Lost PDUs,Time", *[f"{i % 3},{i}" for i in range(20)]]
    write_run(root, "Session_1", "cipheron_0001", {mac: timed(20), pdcp: lost})
    # Other column order, one more column, and cells that hold no number.
    odd = ["SNR (dB),Extra,PDU Size,Time (s)", *[f"{i / 2},x,{100 + i},{i}" for i in range(20)]]
    odd[6] = "NaN,x,NA,5"
    odd[7] = ",x,bad,6"
    write_run(root, "Session_1", "cipheroff_0002", {mac: odd})
    # No clock: rows are cut by number; a textual time column is no clock.
    plain = ["pdu size,SNR (dB),start time", *[f"{i},{i},at {i}" for i in range(40)]]
    write_run(root, "Session_1", "cipher_3", {mac: plain, "220909_125427_SYSOVERVIEW_NA.csv": ["a", "1"]})
    write_run(root, "Session_2", "cipheron_4", {mac: timed(4)})
    write_run(root, "Session_2", "cipheron_5", {"notes.txt": ["nothing"]})
    write_run(root, "Session_2", "cipheroff_6", {"readme.txt": ["x"]}, data_folder=False)
    write_run(root, "Session_2", "cipher_7", {mac: timed(20)})
    write_run(root, "Session_2", "CipherOff_8", {mac: timed(12), pdcp: []})
    write_run(root, "Session_2", "other_9", {mac: timed(20)})
    for session, entries in {
        "Session_1": [("cipheron_0001", "off"), ("cipher_3", " Enabled "), ("cipher_3", "0")],
        "Session_2": [("cipher_7", "maybe"), ("CipherOff_8", 0)],
    }.items():
        with sqlite3.connect(root / "Tranche_A" / session / "metadata.db") as con:
            con.execute("create table configurations (id integer primary key, name text, eNB)")
            con.executemany("insert into configurations (name, eNB) values (?, ?)", entries)
    (root / "Tranche_A" / "Session_3").mkdir()
    (root / "Tranche_A" / "Session_3" / "metadata.db").write_bytes(b"not a database at all")
    return root


@pytest.fixture(scope="module")
def done(spark, root):
    result = ingest(spark, str(root), COLUMNS, trim_seconds=5, min_rows=5)
    return {r.run_id: r for r in result.manifest.collect()}, result


def test_tree(spark, root):
    tree = files.run_tree(files.list_files(spark, str(root), "*.csv"))
    found = {(r.session, r.run_id, r.tag) for r in tree.collect()}
    assert ("Session_1", "cipher_3", "sys_overview") in found
    assert ("Session_1", "cipheron_0001", "pdcp_rx") in found
    assert not any(run == "other_9" for _, run, _ in found)


def test_sizes_cover_all_csvs(spark, root):
    sizes = {r.run_id: r for r in files.run_sizes(files.run_tree(files.list_files(spark, str(root)))).collect()}
    folder = root / "Tranche_A" / "Session_1" / "cipher_3" / "traffic_generator"
    assert sizes["cipher_3"].raw_size_bytes == sum(f.stat().st_size for f in folder.iterdir())
    assert sizes["cipher_3"].n_csv == 2
    assert (sizes["cipheron_5"].n_csv, sizes["cipheron_5"].has_data) == (0, True)
    assert not sizes["cipheroff_6"].has_data
    assert sizes["cipheron_0001"].measurement_ts == "2022-09-09T12:54:27"


def test_label_table(spark, root):
    table = label_db.label_table(label_db.label_files(spark, str(root)))
    found = {(r.session, r.name): r.enb for r in table.collect()}
    assert found == {
        ("Session_1", "cipheron_0001"): "off", ("Session_1", "cipher_3"): " Enabled ",
        ("Session_2", "cipher_7"): "maybe", ("Session_2", "CipherOff_8"): "0",
    }


def test_outcomes(done):
    manifest, _ = done
    outcomes = {run: (r.outcome, r.skip_reason) for run, r in manifest.items()}
    assert outcomes == {
        "cipheron_0001": ("ok", ""), "cipheroff_0002": ("ok", ""), "cipher_3": ("ok", ""),
        "cipheron_4": ("quarantine", "all CSV groups empty after trimming"),
        "cipheron_5": ("skip", "no CSV files in traffic_generator"),
        "cipheroff_6": ("skip", "no traffic_generator folder"),
        "cipher_7": ("quarantine", "cipher state unknown"),
        "CipherOff_8": ("quarantine", "too few rows after trimming: 2"),
    }


def test_manifest_fields(done):
    manifest, _ = done
    first = manifest["cipheron_0001"]
    assert (first.cipher_state, first.cipher_source, first.label_mismatch) == ("on", "folder", True)
    assert (first.csv_files_read, first.row_count, first.col_count, first.run_number) == (2, 10, 10, 1)
    third = manifest["cipher_3"]
    assert (third.cipher_state, third.cipher_source, third.label_mismatch) == ("on", "db", False)
    assert manifest["CipherOff_8"].row_count == 0


def bronze_of(done, run):
    rows = done[1].bronze.where(F.col("run_id") == run).orderBy("ordinal").collect()
    return [(r.ordinal, r.mac_rx__pdu_size, r.mac_rx__snr__db_, r.pdcp_rx__lost_pdus) for r in rows]


def test_merged_rows(done):
    assert bronze_of(done, "cipheron_0001") == [
        (i - 5, 100.0 + i, i / 2, float(i % 3)) for i in range(5, 15)
    ]


def test_header_order_and_bad_cells(done):
    rows = bronze_of(done, "cipheroff_0002")
    assert rows[:2] == [(0, None, None, None), (1, None, None, None)]
    assert rows[2:] == [(i - 5, 100.0 + i, i / 2, None) for i in range(7, 15)]


def test_rows_without_a_clock(done):
    assert [r[1] for r in bronze_of(done, "cipher_3")] == [float(i) for i in range(2, 38)]


def test_spread_ingest_is_the_same(spark, root, done):
    again = ingest(spark, str(root), COLUMNS, trim_seconds=5, min_rows=5)
    assert sorted(map(repr, again.bronze.collect())) == sorted(map(repr, done[1].bronze.collect()))


def test_stored_bronze(spark, done, tmp_path):
    _, result = done
    tables.write_bronze(result.bronze, str(tmp_path / "bronze"))
    names = [c for c in result.bronze.columns if "__" in c]
    back = tables.read_bronze(spark, str(tmp_path / "bronze"), tables.bronze_schema(names))
    assert back.count() == result.bronze.count()
    stored = spark.createDataFrame([("Tranche_A", "Session_1", "cipher_3", "p", 10)],
                                   "tranche string, session string, run_id string, parquet_path string, parquet_size_bytes bigint")
    final = {r.run_id: r for r in finish_manifest(result.manifest, stored).collect()}
    assert final["cipher_3"].parquet_size_bytes == 10 and final["cipher_7"].parquet_path == ""
    assert set(finish_manifest(result.manifest, stored).columns) == {
        part.split()[0] for part in tables.MANIFEST_SCHEMA.split(",")
    }


def test_only_wanted_groups_are_scanned(spark, root):
    path, pattern = csv_groups.group_files(str(root), ["pdcp_rx"])
    scanned = csv_groups.read_cells(spark, path, 2, pattern).inputFiles()
    assert len(scanned) == 2 and all(PDCP in f for f in scanned)
    assert csv_groups.group_files("r", ["a_1"]) == ("r", "*{[aA]?1}.csv")


def test_quoted_header(spark, tmp_path):
    folder = tmp_path / "Tranche_A" / "Session_1" / "cipheron_1" / "traffic_generator"
    folder.mkdir(parents=True)
    (folder / f"220909_125427_{MAC}.csv").write_text('"a, b",PDU Size\n1,2\n')
    tree = files.run_tree(files.list_files(spark, str(tmp_path), "*.csv"))
    rows = csv_groups.read_groups(spark, str(tmp_path), tree, files.csv_headers(tree), {"mac_rx": ["pdu size", "a, b"]})
    assert rows.first()["values"] == [2.0, 1.0]


def test_part_files_of_one_group(spark, tmp_path):
    """A group in several parts is one group, in the order of its parts."""
    base = tmp_path / "tranche=Tranche_B" / "session=Session_9" / "run_id=cipheron_1" / f"file=220909_125427_{MAC}"
    base.mkdir(parents=True)
    (base / "part-00000.csv").write_text("Time,PDU Size\n0,1\n1,2\n")
    (base / "part-00001.csv").write_text("PDU Size,Time\n3,2\n4,3\n")
    tree = files.run_tree(files.list_files(spark, str(tmp_path), "*.csv"))
    rows = csv_groups.read_groups(
        spark, str(tmp_path), tree, files.csv_headers(tree), {"mac_rx": ["pdu size"]}, partitioned=True
    )
    kept = csv_groups.trim_groups(rows, 1).orderBy(*csv_groups.POSITION).collect()
    assert [r["values"][0] for r in kept] == [2.0, 3.0]


@pytest.fixture(scope="module")
def parquet_dir(tmp_path_factory):
    base = tmp_path_factory.mktemp("stored") / "Tranche_A" / "Session_1"
    base.mkdir(parents=True)
    pq.write_table(pa.table({"retransmission_1": pa.array([1, 2], pa.int32()), "flag": [True, False]}), base / "a.parquet")
    pq.write_table(pa.table({"retransmission_1": pa.array([0.5], pa.float32()), "label_mismatch": [True]}), base / "b.parquet")
    (base / "c.parquet").write_bytes((base / "a.parquet").read_bytes()[:40])
    return base.parents[1]


def test_mixed_types_read_as_double(spark, parquet_dir):
    good = [str(parquet_dir / "Tranche_A" / "Session_1" / f"{n}.parquet") for n in "ab"]
    df = tables.read_bronze(spark, good, tables.bronze_schema(["retransmission_1", "absent"]))
    assert sorted(r.retransmission_1 for r in df.collect()) == [0.5, 1.0, 2.0]
    assert df.where("absent is not null").count() == 0


def test_footers(spark, parquet_dir):
    footers = files.footer_columns(files.list_files(spark, str(parquet_dir), "*.parquet"))

    def by_file(df, column="status"):
        return {r.subject.rsplit("/", 1)[1]: r[column] for r in df.collect()}

    assert by_file(quality.boolean_columns(footers)) == {"a.parquet": "FAIL", "b.parquet": "PASS"}
    assert by_file(quality.readable(footers)) == {"a.parquet": "PASS", "b.parquet": "PASS", "c.parquet": "FAIL"}
    assert [r.type for r in quality.dtype_conflicts(footers).collect()] == ["int32"]
    assert {r.column: r.n_types for r in quality.mixed_types(footers).collect()} == {"retransmission_1": 2}
    assert quality.distinct_schemas(footers).first().n_schemas == 2
    counts = quality.column_counts(footers).first()
    assert (counts.tranche, counts.least, counts.most, counts.n_counts) == ("Tranche_A", 2, 2, 1)
    assert quality.schema_uniform(footers).first().status == "WARN"
    missing = spark.createDataFrame([("x",)], "run_id string")
    present = {r.subject: r.observed for r in quality.files_present(missing, footers).collect()}
    assert present == {"missing": 1.0, "unreadable": 1.0}


def test_catalogue_export(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("Layer,,Key\nMAC Layer,junk,a\n,,\nNetwork,,b\n")
    assert [tuple(r) for r in tables.read_catalogue(spark, str(tmp_path / "sheet.csv")).collect()] == [
        ("MAC Layer", "a"), ("Network", "b"),
    ]


@pytest.fixture(scope="module")
def odd_root(tmp_path_factory):
    """Cases in which a reader can take too much, too little, or the wrong rows."""
    root = tmp_path_factory.mktemp("odd")
    mac = f"220909_125427_{MAC}.csv"
    write_run(root, "Session_1", "cipheron_1", {mac: timed(30)})
    for folder in ("logs", "traffic_generator/deeper"):  # CSVs elsewhere in the run
        place = root / "Tranche_A" / "Session_1" / "cipheron_1" / folder
        place.mkdir()
        (place / mac).write_text("\n".join(timed(30, row="{i},9999,9999")))
    broken = ['Time (s),"Long\nNote",PDU Size', *[f'{i},"two\nlines ""{i}""",{i}' for i in range(30)]]
    write_run(root, "Session_1", "cipheron_2", {mac: broken})
    write_run(root, "Session_1", "cipheroff_3", {mac: timed(30), f"220909_130000_{MAC}.csv": timed(30)})
    write_run(root, "Session_1", "cipheroff_4", {mac: ["Time (s),PDU Size"]})
    write_run(root, "Session_1", "cipher_5", {mac: timed(30)})
    write_run(root, "Session_1", "cipheron_6", {"220909_125427_Mac.Rx.csv": timed(30)})  # derived tag: mac_rx
    with sqlite3.connect(root / "Tranche_A" / "Session_1" / "cipher_5" / "metadata.db") as con:  # not the session's
        con.execute("create table configurations (id integer primary key, name text, eNB)")
        con.execute("insert into configurations (name, eNB) values ('cipher_5', 'on')")
    return root


@pytest.mark.parametrize("columns", [{"mac_rx": ["PDU Size"]}, None])
def test_odd_files(spark, odd_root, columns):
    done = ingest(spark, str(odd_root), columns, trim_seconds=5, min_rows=5)
    runs = {r.run_id: r for r in done.manifest.collect()}
    assert {k: (r.outcome, r.skip_reason) for k, r in runs.items()} == {
        "cipheron_1": ("ok", ""), "cipheron_2": ("ok", ""), "cipheron_6": ("ok", ""),
        "cipheroff_3": ("quarantine", "Parquet write failed: duplicate columns of group mac_rx"),
        "cipheroff_4": ("quarantine", "all CSV groups empty after trimming"),
        "cipher_5": ("quarantine", "cipher state unknown"),
    }
    assert runs["cipheroff_4"].measurement_ts == "2022-09-09T12:54:27" and runs["cipheroff_4"].raw_size_bytes > 0
    unknown = runs["cipher_5"]
    assert (unknown.measurement_ts, unknown.raw_size_bytes, unknown.csv_files_read) == (None, 0, 0)
    size = (odd_root / "Tranche_A" / "Session_1" / "cipheron_1" / "traffic_generator" / f"220909_125427_{MAC}.csv").stat().st_size
    assert runs["cipheron_1"].raw_size_bytes == size
    rows = {}
    for r in done.bronze.orderBy("ordinal").collect():
        rows.setdefault(r.run_id, []).append(r.mac_rx__pdu_size)
    assert rows == {
        "cipheron_1": [100.0 + i for i in range(5, 25)], "cipheron_2": [float(i) for i in range(5, 25)],
        "cipheron_6": [100.0 + i for i in range(5, 25)],
    }
    if columns is None:
        assert [c for c in done.bronze.columns if "__" in c] == [f"mac_rx__{c}" for c in ("long_note", "pdu_size", "snr__db_", "time__s_")]
        assert (runs["cipheron_1"].col_count, runs["cipheron_2"].col_count) == (10, 10)


def test_stored_and_read_back(spark, odd_root, tmp_path):
    manifest = ingest_to(spark, str(odd_root), str(tmp_path / "out"), columns={"mac_rx": ["PDU Size"]}, trim_seconds=5, min_rows=5)
    runs = {r.run_id: r for r in manifest.collect()}
    stored = {k for k, r in runs.items() if r.parquet_size_bytes > 0}
    assert stored == {k for k, r in runs.items() if r.outcome == "ok"} == {"cipheron_1", "cipheron_2", "cipheron_6"}
    assert spark.read.parquet(runs["cipheron_1"].parquet_path).count() == 20
    rejected = spark.read.parquet(str(tmp_path / "out" / "quarantine"))
    assert {r.run_id for r in rejected.collect()} == {"cipheroff_3", "cipheroff_4", "cipher_5"}


def test_walk_sees_every_folder(spark, tmp_path):
    """URIs are those of Spark's own listing, and folders are rows, empty ones too."""
    base = tmp_path / "raw tree+1 %41 é"
    for folder in ("Tranche_A/Session_1/cipheron_1", "Tranche_A/Session_1/cipheroff_2/traffic_generator", "Tranche_A/Session_2", "empty", "_hidden/x"):
        (base / folder).mkdir(parents=True)
    for name in ("Tranche_A/Session_1/cipheroff_2/traffic_generator/a b#?,;:[é].csv", "Tranche_A/Session_1/cipheron_1/.skipped", "Tranche_A/top.txt", "_hidden/x/y.csv"):
        (base / name).write_text("a\n1\n")
    rows = {r.uri: r.length for r in files.walk(spark, str(base)).collect()}
    listed = {r.uri: r.length for r in files.list_files(spark, str(base)).collect()}
    assert {u: n for u, n in rows.items() if not u.endswith("/")} == listed and len(listed) == 2
    root = files.root_uri(spark, str(base))
    assert {u.removeprefix(root) for u in rows if u.endswith("/")} == {
        "Tranche_A/", "empty/", "Tranche_A/Session_1/", "Tranche_A/Session_2/", "Tranche_A/Session_1/cipheron_1/",
        "Tranche_A/Session_1/cipheroff_2/", "Tranche_A/Session_1/cipheroff_2/traffic_generator/",
    }
    assert files.walk(spark, str(base / "missing")).collect() == files.walk(spark, str(base / "empty")).collect() == []
    runs = {r.run_id: (r.has_data, r.n_csv, r.raw_size_bytes) for r in files.run_sizes(files.run_tree(files.walk(spark, str(base), files.within_runs))).collect()}
    assert runs == {"cipheron_1": (False, 0, 0), "cipheroff_2": (True, 1, 4)}


def test_runs_without_files_are_in_the_manifest(spark, tmp_path):
    folder = tmp_path / "Tranche_A" / "Session_1"
    (folder / "cipheron_1").mkdir(parents=True)
    (folder / "cipheroff_2" / "traffic_generator").mkdir(parents=True)
    (folder / "cipher_3" / "other" / "deep").mkdir(parents=True)
    (folder / "cipher_3" / "other" / "deep" / "x.csv").write_text("a\n1\n")
    write_run(tmp_path, "Session_1", "cipheron_4", {f"220909_125427_{MAC}.csv": timed(20)})
    done = ingest(spark, str(tmp_path), COLUMNS, trim_seconds=5, min_rows=5)
    assert {r.run_id: (r.outcome, r.skip_reason, r.cipher_state) for r in done.manifest.collect()} == {
        "cipheron_1": ("skip", "no traffic_generator folder", "unknown"), "cipheroff_2": ("skip", "no CSV files in traffic_generator", "off"),
        "cipher_3": ("skip", "no traffic_generator folder", "unknown"), "cipheron_4": ("ok", "", "on"),
    }


def test_versioned_ingest(spark, root, tmp_path):
    """Two ingests make two versions; the manifest names the files of the last one."""
    out = str(tmp_path / "out")
    for number in (1, 2):
        manifest = ingest_to(spark, str(root), out, versioned=True, columns=COLUMNS, trim_seconds=5, min_rows=5)
        assert versions.current(spark, f"{out}/bronze").number == versions.current(spark, f"{out}/manifest").number == number
    found = {r.run_id: r for r in manifest.collect()}
    listed = [r.uri for r in versions.files(spark, f"{out}/bronze").collect()]
    ok = {run: r for run, r in found.items() if r.outcome == "ok"}
    assert set(ok) == {"cipheron_0001", "cipheroff_0002", "cipher_3"}
    assert all(r.parquet_size_bytes > 0 and any(u.startswith(r.parquet_path + "/") for u in listed) for r in ok.values())
    assert {r.run_id for r in versions.read(spark, f"{out}/quarantine").collect()} == {"cipheron_4", "cipher_7", "CipherOff_8"}
    assert versions.read(spark, f"{out}/bronze").groupBy("run_id").count().count() == 3


def test_small_files_are_dealt_out_in_few_tasks(spark, tmp_path):
    """Many small files make no more tasks than the cores ask for, and no list of them on the driver."""
    folder = tmp_path / "Tranche_A" / "Session_1"
    for i in range(150):
        run = folder / f"cipheron_{i}" / "traffic_generator"
        run.mkdir(parents=True)
        (run / f"220909_125427_{MAC}.csv").write_text(f"Time,PDU Size\n0,{i}\n")
    listed = files.list_files(spark, str(tmp_path), "*.csv")
    spark_lists = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(files.file_uri(), "length")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, spark_lists.collect())) and listed.count() == 150
    assert files.list_files(spark, str(tmp_path), "*.txt").count() == 0
    tree = files.run_tree(listed)
    headers = files.csv_headers(tree)
    rows = csv_groups.read_groups(spark, str(tmp_path), tree, headers, {"mac_rx": ["pdu size"]})
    assert sorted(r["values"][0] for r in rows.collect()) == [float(i) for i in range(150)]
    assert headers.rdd.getNumPartitions() == files.n_tasks(spark)
    assert not [f for f in rows.inputFiles() if f.endswith(".csv")]


def test_rows_of_files_are_not_broadcast(spark, tmp_path):
    """Spark takes parsed rows to be as small as the names of their files, and a stored step as small as its compressed files."""
    run = tmp_path / "Tranche_A" / "Session_1" / "cipheron_1" / "traffic_generator"
    run.mkdir(parents=True)
    (run / f"220909_125427_{MAC}.csv").write_text("Time,PDU Size\n" + "1,1\n" * 500)
    (run / f"220909_125427_{PDCP}.csv").write_text("PDU Size\n" + "1\n" * 500)
    tree = files.run_tree(files.list_files(spark, str(tmp_path), "*.csv"))
    rows = csv_groups.read_groups(spark, str(tmp_path), tree, files.csv_headers(tree), {"mac_rx": ["pdu size"], "pdcp_rx": ["pdu size"]})
    trimmed = csv_groups.trim_groups(stored(rows, "rows"), 0)
    merged = merge_long(stored(trimmed, "trimmed"), RUN, "tag", csv_groups.LINE, "values", ["mac_rx", "pdcp_rx"], csv_groups.SPLIT)
    for step, n in ((rows, 1000), (trimmed, 950), (merged, 450)):
        assert len(step.collect()) == n
        assert "BroadcastHashJoin" not in step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
