import itertools
import random

from pyspark.sql import functions as F

from runlens.operators import catalogue


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("ab_", k=rng.randint(1, 7))) for _ in range(80)}
    terms = {"".join(rng.choices("ab_", k=rng.randint(1, 4))) for _ in range(30)} | {"a"}
    pairs = catalogue.containment(
        spark.createDataFrame([(w,) for w in words], "text string"),
        spark.createDataFrame([(t,) for t in terms], "term string"),
    )
    expected = {(w, t) for w, t in itertools.product(words, terms) if t in w}
    assert sorted(map(tuple, pairs.collect())) == sorted(expected)


def test_first_key_wins_in_both_directions(spark):
    features = spark.createDataFrame(
        [("x1", "mac_rx_stats-q_0.5"), ("x2", "ac"), ("x3", "zzz"), ("x4", "rlc-r_1")],
        "new_var_num string, orig_var_name string",
    )
    rows = [
        (0, "", "Network", 1), (1, "rx_stats", "RLC Layers", 2), (2, "MAC_RX", "MAC Layer", 3),
        (3, "RXSTATS", "Network", 9), (4, None, "Network", 1),
    ]
    details = {"key_type": F.lit("discrete"), "data_type": F.lit(None).cast("string"), "min_value": F.col("pos") * 1.5, "max_value": F.lit(None).cast("double")}
    measurands = spark.createDataFrame(rows, "pos int, ue_logging string, layer_raw string, priority int").withColumns(details)
    found = {r.new_var_num: (r.matched_key, r.layer_group, r.priority)
             for r in catalogue.feature_map(features, measurands).collect()}
    assert found == {
        "x1": ("rxstats", "L2 RLC", 2), "x2": ("macrx", "L2 MAC", 3),
        "x3": (None, "Unknown", None), "x4": (None, "Unknown", None),
    }
    described = {r.new_var_num: (r.key_type, r.data_type, r.min_value, r.max_value) for r in catalogue.feature_map(features, measurands).collect()}
    assert described["x1"] == ("discrete", "", 1.5, None) and described["x3"] == ("", "", None, None)
    # Here underscores count and only the feature may contain the key.
    hits = catalogue.priority_features(features, measurands).collect()
    assert [r.new_var_num for r in hits] == ["x1"]


def test_missing_kpi_features(spark):
    features = spark.createDataFrame([("x42", "bler-q_0.95")], "new_var_num string, orig_var_name string")
    found = {(r.kpi, r.new_var_num): r.orig_var_name for r in catalogue.kpi_feature_lookup(features).collect()}
    assert found[("bler_spread", "x42")] == "bler-q_0.95"
    assert found[("bler_spread", "x38")] == "NOT FOUND"
    assert not any(kpi == "pdcp_discard_rate" for kpi, _ in found)
