"""Forests that are grown by tasks, against plain forms of their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import models, random_forest, shapley


def _runs(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(f"run{i}", "on" if i % 2 else "off", float(rng.normal(i % 2)), float(rng.integers(4)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, cipher_state string, signal double, few double, noise double")


NAMES = ["signal", "few", "noise"]


def test_a_forest_does_not_depend_on_how_rows_are_dealt_out(spark):
    runs = _runs(spark, 90)
    found = [
        sorted(shapley.forest_nodes(models.fit_random_forest(df, NAMES, trees=6, depth=5)).select("tree", "node", "feature", "left", "right", "off_rows", "on_rows").collect())
        for df in (runs.repartition(7, "run_id"), runs.coalesce(1).orderBy(F.desc("run_id")))
    ]
    assert found[0] == found[1] and {r.tree for r in found[0]} == set(range(6))


def test_trees_are_stored_by_tasks(spark):
    """The node table comes from files that several tasks wrote; scores are the mean of its leaves."""
    runs = _runs(spark, 60)
    model = models.fit_random_forest(runs, NAMES, trees=12, depth=6)
    assert len(random_forest.part_files(model.stages[-1].uri)) > 1
    nodes = {t: g.set_index("node") for t, g in shapley.forest_nodes(model).toPandas().groupby("tree")}
    points = {r.run_id: r.features for r in model.stages[0].transform(runs).select("run_id", "features").collect()}
    for r in models.predict(model, runs, ["run_id"]).collect():
        values = []
        for table in nodes.values():
            at = 0
            while table.left[at] >= 0:
                at = table.left[at] if points[r.run_id][table.feature[at]] <= table.threshold[at] else table.right[at]
            values.append(table.value[at])
        assert r.score == pytest.approx(np.mean(values), abs=1e-12) and r.predicted == ("on" if np.mean(values) > 0.5 else "off")


def test_importances_are_shares_of_gains(spark):
    model = models.fit_random_forest(_runs(spark, 60), NAMES, trees=5, depth=4)
    nodes = shapley.forest_nodes(model).where("left >= 0").toPandas()
    gained = (nodes.gain * (nodes.off_rows + nodes.on_rows)).groupby([nodes.tree, nodes.feature]).sum().unstack(fill_value=0)
    shares = gained.div(gained.sum(axis=1), axis=0).sum()
    assert list(model.stages[-1].featureImportances) == pytest.approx(list((shares / shares.sum()).reindex(range(3), fill_value=0)))


def test_cut_points():
    assert list(random_forest.cut_points(np.array([3.0, 1.0, 1.0, 2.0]), 32)) == [1.5, 2.5]
    values = np.random.default_rng(0).normal(size=1000).round(2)
    cuts = random_forest.cut_points(values, 8)
    assert len(cuts) == 7 and max(np.histogram(values, [-np.inf, *cuts, np.inf])[0]) < 140
    heavy = np.concatenate([np.zeros(900), np.arange(1.0, 101.0)])  # the rule of Spark ML, step by step
    distinct, counts = np.unique(heavy, return_counts=True)
    expected, current, target = [], counts[0], len(heavy) / 8
    for i in range(1, len(distinct)):
        before, current = current, current + counts[i]
        if abs(before - target) < abs(current - target):
            expected.append((distinct[i - 1] + distinct[i]) / 2)
            target += len(heavy) / 8
    assert list(random_forest.cut_points(heavy, 8)) == expected


@pytest.mark.parametrize("memory", [0, 64])
def test_splits_are_the_best_and_equal_siblings_are_one_leaf(memory):
    """With one feature it is always drawn, so each split must be the best of all its cuts; passes of any size give the same tree."""
    rng = np.random.default_rng(1)
    codes, on, weights = rng.integers(0, 12, (200, 1)).astype(np.uint8), rng.random(200) < 0.4, rng.poisson(1.0, 200)
    nodes = random_forest.grow(codes, on, weights, [np.arange(11) + 0.5], 0, np.random.default_rng(7), 30, memory).set_index("node")
    kept = {0: np.ones(200, bool)}
    for i, r in nodes.iterrows():
        own = kept[i]
        n_off, n_on = (weights[own & (on == side)].sum() for side in (False, True))
        assert (r.off_rows, r.on_rows) == (n_off, n_on)
        if r.left < 0:
            continue
        gini = lambda m: 1 - sum((weights[m & (on == s)].sum() / weights[m].sum()) ** 2 for s in (False, True))
        gains = []
        for cut in range(11):
            sides = own & (codes[:, 0] <= cut), own & (codes[:, 0] > cut)
            if all(weights[s].sum() for s in sides):
                gains.append((gini(own) - sum(weights[s].sum() / weights[own].sum() * gini(s) for s in sides), cut + 0.5))
        assert r.gain == pytest.approx(max(g for g, _ in gains)) and r.threshold in [c for g, c in gains if g > max(gains)[0] - 1e-12]
        below = codes[:, 0] <= r.threshold
        kept[r.left], kept[r.right] = own & below, own & ~below
        a, b = nodes.loc[r.left], nodes.loc[r.right]
        assert a.left >= 0 or b.left >= 0 or (a.on_rows > a.off_rows) != (b.on_rows > b.off_rows)


def test_one_class_and_no_rows(spark):
    model = models.fit_random_forest(_runs(spark, 40).where("cipher_state = 'on'"), NAMES, trees=3, depth=4)
    assert {(r.left, r.value) for r in shapley.forest_nodes(model).collect()} == {(-1, 1.0)}
    with pytest.raises(ValueError, match="needs rows"):
        random_forest.RandomForest(numTrees=2).fit(spark.createDataFrame([], "target double, x double").selectExpr("target").join(model.stages[0].transform(_runs(spark, 4)).select("features").limit(0)))


def test_switched_values_are_those_of_every_step(spark):
    """Sampled Shapley values from the leaves that are passed, against the forest's score at every step; runs come twice, too."""
    rng = np.random.default_rng(6)
    runs = _runs(spark, 30)
    model = models.fit_random_forest(runs, NAMES, trees=7, depth=6)
    trees = [t for part in random_forest.part_files(model.stages[-1].uri) for t in random_forest.trees_in(part)]
    own, base = rng.normal(size=(2, 40, 3)).round(1)
    ranks = np.array([rng.permutation(3) for _ in own])
    found = sum(random_forest.switch_gains(t, own, base, ranks) for t in trees)
    steps = [np.where(ranks < s, own, base) for s in range(4)]
    scores = [sum(random_forest.tree_votes(t, p)[1] for t in trees) for p in steps]
    assert found == pytest.approx(np.diff(np.stack(scores, axis=1), axis=1), abs=1e-12)
    twice = runs.union(runs.limit(3))
    sums = {r.run_id: r.total for r in models.shapley_values(model, twice, "run_id", NAMES, samples=5).groupBy("run_id").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where("n = 3").collect()}
    known = {r.run_id: r.score for r in models.predict(model, runs, ["run_id"]).collect()}
    times = {r.run_id: r["count"] for r in twice.groupBy("run_id").count().collect()}
    assert set(sums) == set(known)
    first = {times[r]: known[r] - sums[r] / times[r] for r in known}  # the background's mean score
    assert all(known[r] - sums[r] / times[r] == pytest.approx(first[1], abs=1e-9) for r in known)
