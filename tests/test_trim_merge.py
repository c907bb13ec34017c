from pyspark.sql import functions as F

from runlens.operators import manifest, merge, trim
from runlens.operators.rows import attach_metadata


def test_time_trim_keeps_the_bounds(spark):
    df = spark.createDataFrame(
        [("a", float(t)) for t in (0, 4, 5, 7, 15, 16, 20)] + [("b", 0.0), ("b", 9.0), ("a", None)],
        "run string, t double",
    )
    kept = trim.time_trim(df, ["run"], "t", F.lit(5.0)).collect()
    assert sorted(r.t for r in kept) == [5.0, 7.0, 15.0]
    assert {r.run for r in kept} == {"a"}


def test_row_trim_sizes(spark):
    sizes = {"n1": 1, "n2": 2, "n3": 3, "n40": 40, "n1000": 1000}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    kept = {}
    for r in trim.row_trim(df, ["g"], ["i"]).collect():
        kept.setdefault(r.g, []).append(r.i)
    assert sorted(kept["n1"]) == [0] and sorted(kept["n2"]) == [0, 1]
    assert sorted(kept["n3"]) == [1]
    assert sorted(kept["n40"]) == list(range(2, 38))
    assert sorted(kept["n1000"]) == list(range(25, 975))


def test_missing_group_does_not_drop_the_run(spark):
    data = [("r1", "a", i, float(i)) for i in range(4)] + [("r1", "b", i, 10.0 + i) for i in range(3)]
    data += [("r2", "a", i, float(i)) for i in range(2)]
    df = spark.createDataFrame(data, "run string, grp string, pos int, v double")
    expected = {("r1", i, float(i), 10.0 + i) for i in range(3)} | {("r2", i, float(i), None) for i in range(2)}
    long = merge.merge_long(df, ["run"], "grp", ["pos"], "v", ["a", "b"])
    assert {tuple(r) for r in long.select("run", "ordinal", "a__v", "b__v").collect()} == expected
    frames = {g: df.where(F.col("grp") == g).select("run", "pos", F.col("v").alias(f"{g}__v")) for g in "ab"}
    wide = merge.merge_frames(frames, ["run"], ["pos"])
    assert {tuple(r) for r in wide.select("run", "ordinal", "a__v", "b__v").collect()} == expected


def test_bottleneck(spark):
    sizes = spark.createDataFrame([("r", "a", 9), ("r", "b", 2), ("r", "c", 9)], "run string, grp string, n_rows int")
    found = {r.grp: (r.min_rows, r.shortness) for r in merge.bottleneck_groups(sizes, ["run"], "grp").collect()}
    assert found == {"b": (2, 1), "a": (2, 2), "c": (2, 2)}


def test_outcome_rules_in_order(spark):
    cases = [
        (False, "unknown", 0, 0, 0, "skip", "no traffic_generator folder"),
        (True, "unknown", 0, 0, 0, "quarantine", "cipher state unknown"),
        (True, "on", 0, 0, 0, "skip", "no CSV files in traffic_generator"),
        (True, "on", 3, 0, 0, "quarantine", "all CSV groups empty after trimming"),
        (True, "off", 3, 3, 199, "quarantine", "too few rows after trimming: 199"),
        (True, "off", 3, 3, 200, "ok", ""),
    ]
    df = spark.createDataFrame(
        cases, "has boolean, label string, csv int, groups int, n int, outcome string, reason string"
    )
    decided = manifest.run_outcome(*[F.col(c) for c in ("has", "label", "csv", "groups", "n")])
    for r in df.select(decided["outcome"].alias("o"), decided["skip_reason"].alias("s"), "outcome", "reason").collect():
        assert (r.o, r.s) == (r.outcome, r.reason)


def test_write_failures(spark):
    runs = spark.createDataFrame(
        [("A", "1", "r1", "ok", ""), ("A", "1", "r2", "ok", ""), ("A", "1", "r3", "skip", "x")],
        "tranche string, session string, run_id string, outcome string, skip_reason string",
    )
    broken = spark.createDataFrame([("A", "1", "r1", "disk full"), ("A", "1", "r3", "y")],
                                   "tranche string, session string, run_id string, write_error string")
    found = {r.run_id: (r.outcome, r.skip_reason) for r in manifest.write_failures(runs, broken).collect()}
    assert found == {"r1": ("quarantine", "Parquet write failed: disk full"), "r2": ("ok", ""), "r3": ("skip", "x")}


def test_size_ratio_without_output(spark):
    df = spark.createDataFrame([("skip", False, 100, 0)],
                               "outcome string, label_mismatch boolean, raw_size_bytes bigint, parquet_size_bytes bigint")
    assert manifest.manifest_summary(df).first().size_ratio == 0.0


def test_metadata_comes_first(spark):
    rows = spark.createDataFrame([("r1", 1.0)], "run_id string, v double")
    runs = spark.createDataFrame([("r1", "on")], "run_id string, cipher_state string")
    assert attach_metadata(rows, runs, ["run_id"]).columns == ["run_id", "cipher_state", "v"]
