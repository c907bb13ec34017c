import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import compare, forest, models


@pytest.fixture(scope="module")
def shifted(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        on = i % 2 == 0
        rows.append((
            f"run{i}", "Tranche_" + "ABC"[i % 3], "on" if on else "off",
            float(np.round(rng.normal(2.0 if on else 0.0), 2)), float(rng.normal()), float(rng.normal()),
        ))
    return spark.createDataFrame(
        rows, "run_id string, tranche string, cipher_state string, signal double, noise double, other double"
    ).cache()


FEATURES = ["signal", "noise", "other"]


def test_auc_against_all_pairs(shifted):
    data = shifted.toPandas()
    up, down = (data.loc[data.cipher_state == c, "signal"].to_numpy() for c in ("on", "off"))
    gaps = up[:, None] - down[None, :]
    expected = ((gaps > 0).sum() + (gaps == 0).sum() / 2) / gaps.size
    found = models.auc(shifted, "signal").first()
    assert found.auc == pytest.approx(expected) and found.n_positive == len(up)
    assert models.auc(shifted, "signal", "off").first().auc == pytest.approx(1 - expected)


def test_auc_of_noise(shifted):
    assert 0.4 < models.auc(shifted, "noise").first().auc < 0.6


def test_threshold_against_all_cuts(shifted):
    data = shifted.toPandas()
    on = (data.cipher_state == "on").to_numpy()
    best = max(
        max(((data.signal > t) == on).mean(), ((data.signal <= t) == on).mean()) for t in data.signal.unique()
    )
    found = models.threshold_baseline(shifted, "signal").first()
    assert found.accuracy == pytest.approx(best) and found.on_side == "above"


def test_models_learn_the_shift(shifted):
    parts = models.split_tranches(shifted)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    keep = ["run_id", "tranche", "cipher_state"]
    for fitted in (models.fit_logistic(train, FEATURES), models.fit_random_forest(train, FEATURES, trees=20, depth=8)):
        scored = models.predict(fitted, test, keep)
        assert models.auc(scored, "score").first().auc > 0.85
        assert {r.tranche for r in models.accuracy(scored, "tranche").collect()} == {"Tranche_A", "Tranche_C"}
    first = models.coefficients(models.fit_logistic(train, FEATURES), train, FEATURES).first()
    assert first.feature == "signal" and first.coefficient > 0


def test_shuffled_labels_teach_nothing(shifted):
    order = F.when(F.xxhash64("run_id") % 2 == 0, "on").otherwise("off")
    parts = models.split_tranches(shifted.withColumn("cipher_state", order))
    fitted = models.fit_logistic(parts.where("part = 'train'"), FEATURES)
    scored = models.predict(fitted, parts.where("part = 'test'"), ["cipher_state"])
    assert 0.3 < models.auc(scored, "score").first().auc < 0.7


def test_shapley_ranks_the_signal_first(shifted):
    fitted = models.fit_logistic(models.with_target(shifted), FEATURES)
    table = {r.feature: r.importance for r in models.shapley_importance(fitted, shifted, "run_id", FEATURES).collect()}
    assert set(table) == set(FEATURES)
    assert table["signal"] > 3 * max(table["noise"], table["other"])


def test_shapley_values_of_one_feature_add_up(shifted):
    """With one feature its value is the mean score minus the background's, whatever the draw."""
    fitted = models.fit_logistic(models.with_target(shifted), ["signal"])
    found = models.shapley_importance(fitted, shifted, "run_id", ["signal"], samples=240).first().importance
    scores = models.predict(fitted, shifted, ["run_id"]).toPandas()["score"]
    assert found == pytest.approx(np.abs(scores - scores.mean()).mean(), rel=1e-6)


def test_isolation_forest(spark, shifted):
    far = spark.createDataFrame([("far", "Tranche_A", "off", 30.0, 30.0, -30.0)], shifted.schema)
    normal = shifted.where("cipher_state = 'on'")
    nodes = forest.fit_forest(normal, "run_id", FEATURES, trees=50, sample=64)
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.max("size").alias("rows"), F.max("depth").alias("depth"))
    for r in sizes.collect():
        assert r.n <= 2 * 64 - 1 and r.rows == 64 and r.depth <= 6
    scores = forest.score_forest(shifted.unionByName(far), nodes, FEATURES, 64).toPandas().set_index("run_id")["score"]
    assert scores.idxmin() == "far" and scores["far"] < 0 < scores.drop("far").median() + 0.1
    assert models.auc(forest.score_forest(shifted, nodes, FEATURES, 64), "score").first().auc > 0.6


def test_mean_path():
    assert list(forest.mean_path(np.array([1, 2]))) == [0.0, 1.0]
    assert forest.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_histogram_of_constants(spark):
    df = spark.createDataFrame([("on", 1.0), ("off", 1.0), ("on", None)], "cipher_state string, v double")
    assert sorted(tuple(r) for r in compare.histogram(df, "v", 10).collect()) == [("off", 0, 1), ("on", 0, 1)]


def test_separation_and_overlap(spark):
    rows = [("off", float(v)) for v in range(10)] + [("on", 8.0 + v) for v in range(10)]
    df = spark.createDataFrame(rows, "cipher_state string, v double")
    found = compare.class_separation(df, "v").first()
    assert found.iqr_separated and found.tails_overlap


def test_directions(spark):
    rows = [("off", 1.0, 0.0, 5.0, -10.0), ("on", 2.0, 0.0, 5.001, -12.0)]
    df = spark.createDataFrame(rows, "cipher_state string, a double, b double, c double, d double")
    found = {r.kpi: r.direction for r in compare.kpi_direction(df, ["a", "b", "c", "d"]).collect()}
    assert found == {"a": "higher", "b": "zero in both", "c": "no difference", "d": "lower"}
