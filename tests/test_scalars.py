import pytest
from pyspark.sql import functions as F

from runlens.functions import catalogue, labels, names, stats


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_labels_from_names(spark):
    found = values(spark, labels.label_from_name,
                   ["cipherON_1", "CIPHEROFF_2", "cipher_3", "my_cipheron", None])
    assert found == ["on", "off", None, None, None]
    assert values(spark, labels.name_mentions_label, ["my_cipheron", "x_CipherOff", "y"]) == ["on", "off", None]


def test_label_spellings(spark):
    raw = [" On ", "1", "TRUE", "enabled", "0", "False", "maybe", None]
    assert values(spark, labels.normalize_label, raw) == ["on", "on", "on", "on", "off", "off", None, None]


def test_display_of_the_anomalous_class(spark):
    shown = values(spark, lambda c: labels.label_display(c, "on"), ["on", "off", "unknown"])
    assert shown == ["Cipher ON (misconfigured)", "Cipher OFF (normal)", None]


@pytest.mark.parametrize("name, table, expected", [
    ("on", "off", ("on", "folder", True)), ("on", None, ("on", "folder", False)),
    (None, "off", ("off", "db", False)), (None, None, ("unknown", "none", False)),
    ("off", "off", ("off", "folder", False)),
])
def test_resolved_label(spark, name, table, expected):
    df = spark.createDataFrame([(name, table)], "a string, b string")
    assert tuple(df.select(*labels.resolve_label(F.col("a"), F.col("b")).values()).first()) == expected


def test_run_numbers(spark):
    long = "run_" + "9" * 30
    assert values(spark, names.run_number, ["cipheron_0042", "run", "7", "a1b", long]) == [42, -1, 7, -1, -1]


def test_stems(spark):
    stems = ["220909_125427_L1_X", "abcdef_ghijkl_G", "short", "12345_123456_G", "220909_125427"]
    assert values(spark, names.group_name, stems) == ["L1_X", "G", "short", "G", "220909_125427"]
    assert values(spark, names.measurement_ts, stems) == [
        "2022-09-09T12:54:27", "20ab-cd-efTgh:ij:kl", None, None, "2022-09-09T12:54:27",
    ]


def test_tags(spark):
    groups = ["UECOMBINED_MACRXSTATS_ALL", "SYSOVERVIEW_NA", "New Group (x) " + "y" * 30]
    tags = values(spark, names.group_tag, groups)
    assert tags == ["mac_rx", "sys_overview", "new_group__x__" + "y" * 11]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`A B` int, `a-b` int")
    assert names.normalize_columns(df).columns == ["a_b", "a-b"]
    with pytest.raises(ValueError, match="a_b"):
        names.sanitize_columns(df)


def test_bytes_and_text(spark):
    sizes = [0, 999_949, 999_999, 1_000_000, 2_500_000_000]
    df = spark.createDataFrame([(s,) for s in sizes], "x bigint")
    shown = [r[0] for r in df.select(names.format_bytes(F.col("x"))).collect()]
    assert shown == ["0.0 KB", "999.9 KB", "1000.0 KB", "1.0 MB", "2.50 GB"]
    assert values(spark, names.truncate_text, [None, "x" * 100]) == ["", "x" * 90]


def test_numbers(spark):
    raw = ["1.5", "NaN", "NA", "", None, " 2 ", "-1e3"]
    assert values(spark, stats.number, raw) == [1.5, None, None, None, None, 2.0, -1000.0]


def test_feature_names(spark):
    raw = ["bler-q_0.95", "rsrq-r_-10.5", "a-q_b-q_0.5", "plain", "x-q_abc", "x-r_"]
    df = spark.createDataFrame([(r,) for r in raw], "x string")
    rows = [tuple(r) for r in df.select(*catalogue.parse_feature_name(F.col("x")).values()).collect()]
    assert rows == [
        ("bler", "quantile", "0.95"), ("rsrq", "proportion", "-10.5"), ("a-q_b", "quantile", "0.5"),
        ("plain", "metadata", None), ("x-q_abc", "metadata", None), ("x-r_", "metadata", None),
    ]


def test_layers(spark):
    texts = [None, "", "Physical Layer (Broadcast Channel)", "DL PDCP Layer (Overview of the Cell)",
             "mac layer", "Network", "RLC Layers", "Mystery"]
    assert values(spark, catalogue.layer_of_text, texts) == [
        "Unknown", "Unknown", "L1 Physical", "L2 PDCP", "L2 MAC", "Wireshark", "L2 RLC", "Other",
    ]
    assert values(spark, catalogue.layer_of_feature, ["L1x", "vsa_1", "pdcprx", "x1"]) == [
        "L1 Physical", "L1 Physical", "L2 PDCP", "Metadata/Other",
    ]


def test_null_semantics_of_shares(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (0.0, None)], "a double, b double")
    row = df.agg(
        stats.share(F.col("a") > 0), F.avg(stats.row_sum([F.col("a"), F.col("b")])),
        F.stddev_samp(F.lit(1.0)),
    ).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] == 2.0
