"""Exact Shapley values of trees against the definition over all sets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import models, shapley

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def random_tree(rng, tree, depth, features):
    rows = []

    def grow(level):
        here = len(rows)
        rows.append(None)
        if level == depth or rng.random() < 0.2:
            rows[here] = (tree, here, -1, None, -1, -1, float(rng.normal()))
        else:
            left, right = grow(level + 1), grow(level + 1)
            rows[here] = (tree, here, int(rng.integers(features)), float(np.round(rng.normal(), 1)), left, right, None)
        return here

    grow(0)
    return rows


def value_of(rows, x):
    at = rows[0]
    while at[2] >= 0:
        at = rows[at[4] if x[at[2]] <= at[3] else at[5]]
    return at[6]


def by_definition(trees, x, background):
    d = len(x)
    worth = {}
    for size in range(d + 1):
        for chosen in itertools.combinations(range(d), size):
            mixed = [[x[i] if i in chosen else z[i] for i in range(d)] for z in background]
            worth[chosen] = float(np.mean([np.mean([value_of(t, m) for t in trees]) for m in mixed]))
    out = []
    for i in range(d):
        total = 0.0
        for chosen in worth:
            if i not in chosen:
                weight = math.factorial(len(chosen)) * math.factorial(d - len(chosen) - 1) / math.factorial(d)
                total += weight * (worth[tuple(sorted((*chosen, i)))] - worth[chosen])
        out.append(total)
    return out, worth[tuple(range(d))], worth[()]


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    d = 5
    trees = [random_tree(rng, t, 4, d) for t in range(4)]
    runs, background = np.round(rng.normal(size=(8, d)), 1), np.round(rng.normal(size=(6, d)), 1)
    nodes = spark.createDataFrame([r for t in trees for r in t], NODES)
    frame = lambda m: spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(m)], "run string, own array<double>")
    found = {r.run: r for r in shapley.explain(frame(runs), "run", shapley.forest_leaves(nodes), frame(background), len(trees)).collect()}
    for i, x in enumerate(runs):
        values, score, base = by_definition(trees, x, background)
        row = found[f"r{i}"]
        assert row["values"] == pytest.approx(values, abs=1e-12)
        assert (row.score, row.base) == (pytest.approx(score), pytest.approx(base))


def test_single_leaf_and_no_background(spark):
    nodes = spark.createDataFrame([(0, 0, -1, None, -1, -1, 0.25)], NODES)
    runs = spark.createDataFrame([("a", [1.0, 2.0])], "run string, own array<double>")
    (row,) = shapley.explain(runs, "run", shapley.forest_leaves(nodes), runs, 1).collect()
    assert (row["values"], row.score, row.base) == ([0.0, 0.0], 0.25, 0.25)
    assert shapley.explain(runs, "run", shapley.forest_leaves(nodes), runs.where("false"), 1).collect() == []


def test_fitted_forest(spark):
    rng = np.random.default_rng(2)
    rows = [(f"run{i}", "on" if i % 2 else "off", float(rng.normal(i % 2)), float(rng.normal()), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id string, cipher_state string, signal double, noise double, other double")
    names = ["signal", "noise", "other"]
    model = models.fit_random_forest(df, names, trees=15, depth=6)
    nodes = shapley.forest_nodes(model)
    assert all(r.rows_add_up and r.impurity_fits and r.gain_fits for r in shapley.checked_nodes(nodes).collect())
    explained = shapley.forest_shapley(model, df, "run_id", df.limit(40)).cache()
    known = {r.run_id: r.score for r in models.predict(model, df, ["run_id"]).collect()}
    for r in explained.collect():
        assert r.score == pytest.approx(known[r.run_id], abs=1e-12)
        assert sum(r["values"]) == pytest.approx(r.score - r.base, abs=1e-9)
    table = {r.feature: r.importance for r in shapley.importance(explained, names).collect()}
    assert max(table, key=table.get) == "signal"
    long = shapley.values_by_feature(explained, "run_id", names).groupBy("feature").agg(F.avg(F.abs("value")).alias("m"))
    assert {r.feature: pytest.approx(r.m) for r in long.collect()} == table


def test_equal_bits_are_one_pattern():
    """Rows that meet the same bounds are one pattern, on paths of more features than a word has bits too."""
    rng = np.random.default_rng(3)
    for width in (3, 64, 70):
        met = rng.random((12, width)) < 0.7
        met[6:] = met[:6]
        words, rows, place, times = shapley._patterns(met)
        assert len(words) == len(np.unique(met, axis=0)) and times.sum() == 12 and (rows[place] == met).all()


def test_forest_keeps_its_rows_nodes(spark):
    """Growing trees are not shipped to the tasks at every level, and a level is split in few passes."""
    rows = [(f"r{i}", "on" if i % 2 else "off", float(i % 7), float(i % 5)) for i in range(60)]
    fitted = models.fit_random_forest(spark.createDataFrame(rows, "run_id string, cipher_state string, a double, b double"), ["a", "b"], trees=5, depth=4)
    forest = fitted.stages[-1]
    assert forest.getOrDefault("cacheNodeIds") and forest.getOrDefault("maxMemoryInMB") == models.NODES_MB


def test_neighbours_share_their_work():
    """Leaves that are worked out together, far ones, wide ones and impossible ones: against a plain sum over leaves, runs and background."""
    rng = np.random.default_rng(8)
    width, own, base = 70, rng.normal(size=(9, 70)).round(1), rng.normal(size=(5, 70)).round(1)
    leaves, path = [], {}
    for i in range(40):
        if i % 6 == 0:  # another part of the tree
            path = {int(f): (-np.inf, 1.5) for f in rng.choice(width, 68 if i == 18 else rng.integers(0, 9), replace=False)}
        f = int(rng.integers(width))
        path = path | {f: (-1.0, 2.0) if i % 3 else (0.5, np.inf)}
        leaves.append((float(i % 5), dict(path) | ({3: (1.0, 1.0)} if i == 7 else {})))
    expected, score, mean = np.zeros((width, 9)), np.zeros(9), 0.0
    for value, bounds in leaves:
        for z in base:
            mean += value * all(lo < z[f] <= hi for f, (lo, hi) in bounds.items()) / len(base)
            for r, x in enumerate(own):
                mine, theirs = ({f for f, (lo, hi) in bounds.items() if lo < p[f] <= hi} for p in (x, z))
                if mine | theirs != set(bounds):
                    continue
                a, b = len(mine - theirs), len(theirs - mine)
                for f in mine - theirs:
                    expected[f, r] += value / len(base) * math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
                for f in theirs - mine:
                    expected[f, r] -= value / len(base) * math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
        score += [value * all(lo < x[f] <= hi for f, (lo, hi) in bounds.items()) for x in own]
    order = [sorted(bounds) for _, bounds in leaves]
    low, high = (np.array([bounds[f][s] for (_, bounds), fs in zip(leaves, order, strict=True) for f in fs]) for s in (0, 1))
    flat = np.array([v for v, _ in leaves]), np.cumsum([0, *map(len, order)]), np.concatenate(order).astype(int), low, high
    found = shapley.contributions(own, base, flat)
    assert found[0] == pytest.approx(expected, abs=1e-12) and found[1] == pytest.approx(score) and found[2] == pytest.approx(mean)


def test_leaves_do_not_pass_the_driver(spark, monkeypatch):
    """Runs and leaves are stored and read by tasks; only the background is collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("rows were taken to the driver")

    rng = np.random.default_rng(9)
    nodes = spark.createDataFrame([r for t in range(3) for r in random_tree(rng, t, 4, 3)], NODES)
    runs = spark.createDataFrame([(f"r{i}", rng.normal(size=3).tolist()) for i in range(20)], "run string, own array<double>")
    monkeypatch.setattr(shapley, "BLOCK", 6)
    monkeypatch.setattr(DataFrame, "toArrow", refused)
    monkeypatch.setattr(DataFrame, "toPandas", refused)
    found = shapley.explain(runs, "run", shapley.forest_leaves(nodes), runs.limit(4), 3)
    monkeypatch.undo()
    assert {r.run for r in found.collect()} == {f"r{i}" for i in range(20)}
    assert all(sum(r["values"]) == pytest.approx(r.score - r.base, abs=1e-9) for r in found.collect())
