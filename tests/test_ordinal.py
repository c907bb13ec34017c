"""Positions across tasks must be what one window gives, also with one huge group."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import features, merge, silver
from runlens.operators.ordinal import exact_quantiles, row_ordinal, running_total
from runlens.plans.registry import Tables
from runlens.plans.views import GROUP_NAMES, GROUPS_MISSING, NATIVE

def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows in one group, one key null."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 5))
    return spark.range(4000).select(
        key.alias("key"), (F.col("id") * 7919 % 4001).alias("place"), (F.col("id") % 13).cast("double").alias("v")
    )


def plain_position(df, order):
    """One window over the whole group."""
    return df.withColumn("ordinal", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("bigint"))


def test_positions(skewed):
    spread = row_ordinal(skewed, ["key"], ["place"])
    assert rows(plain_position(skewed, ["place"]).select("key", "place", "ordinal")) == rows(spread.select("key", "place", "ordinal"))
    hot = sorted(r.ordinal for r in spread.where("key = 'hot'").collect())
    assert hot == list(range(2000))


def test_global_running_total(skewed):
    spread = running_total(skewed, [], ["place"], F.col("v"), "sum")
    data = sorted((r.place, r.v) for r in skewed.collect())
    expected = np.cumsum([v for _, v in data])
    assert [r["sum"] for r in spread.orderBy("place").collect()] == pytest.approx(list(expected))


def test_descending_order(skewed):
    order = [F.desc("place")]
    assert rows(plain_position(skewed, order)) == rows(row_ordinal(skewed, ["key"], order))


def test_quantiles(skewed):
    points = {"low": 0.0, "q05": 0.05, "median": 0.5, "q95": 0.95, "top": 1.0}
    found = {r["key"]: r for r in exact_quantiles(skewed, ["key"], "v", points).collect()}
    data = {}
    for r in skewed.collect():
        data.setdefault(r["key"], []).append(r.v)
    assert set(found) == set(data)
    for key, values in data.items():
        for name, p in points.items():
            assert found[key][name] == pytest.approx(np.quantile(values, p))


def test_quantiles_leave_nulls_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.5


def test_merge_against_pandas(spark, sf_dir):
    groups = Tables(spark, sf_dir)(GROUPS_MISSING)
    merged = merge.merge_long(groups, ["run_id"], "grp", ["ts", "event_id"], "value", GROUP_NAMES).toPandas()
    data = groups.toPandas().sort_values(["run_id", "grp", "ts", "event_id"])
    data["ordinal"] = data.groupby(["run_id", "grp"]).cumcount()
    least = data.groupby(["run_id", "grp"]).size().groupby("run_id").min()
    data = data[data.ordinal < data.run_id.map(least)]
    wide = data.pivot(index=["run_id", "ordinal"], columns="grp", values="value")
    merged = merged.set_index(["run_id", "ordinal"]).sort_index()
    assert merged.index.equals(wide.index)
    for name in GROUP_NAMES:
        np.testing.assert_array_equal(merged[f"{name}__value"].to_numpy(), wide[name].to_numpy())


def test_sketch_error_bound(spark):
    """More rows than the accuracy: ranks are off by at most rows / accuracy, however the rows are spread."""
    n, accuracy = 300_000, 1000
    df = spark.range(n).select(F.lit("r").alias("run"), (F.col("id") * 7919 % n).cast("double").alias("m"))
    for parts in (1, 13):
        found = features.feature_quantiles(df.repartition(parts), "run", ["m"], [0.05, 0.5, 0.95], accuracy).collect()
        for r in found:
            assert abs(r.value - float(r.feature_value) * n) <= n / accuracy + 1


def test_partition_count_does_not_matter(spark, sf_dir):
    """But for the last rounded digit of a mean that lies on a tie: floating-point sums depend on their order."""
    bronze = Tables(spark, sf_dir)(NATIVE)
    one, many = (rows(silver.run_features(bronze.repartition(n), ["bler", "rlc"])) for n in (1, 16))
    assert len(one) == len(many)
    for a, b in zip(one, many, strict=True):
        assert a[:6] == b[:6] and list(a[6:]) == pytest.approx(list(b[6:]), abs=1.01e-4)
