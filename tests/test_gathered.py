"""Silver over rows in no order of runs."""

from pyspark.sql import functions as F

from runlens.operators import forest, silver


def _rows(spark, n):
    sources = {c for f in silver.FEATURES for c in f.sources}
    run = (F.col("id") % 7).cast("string").alias("run_id")
    values = [((F.col("id") * 37 + i) % 101).cast("double").alias(c) for i, c in enumerate(sorted(sources))]
    return spark.range(n, numPartitions=5).select(
        run, F.when(F.col("id") % 7 < 3, "on").otherwise("off").alias("cipher_state"), F.concat(F.lit("T"), F.col("id") % 7 % 2).alias("tranche"), F.concat(F.lit("S"), F.col("id") % 7 % 3).alias("session"),
        F.col("id").alias("measurement_ts"), *values,
    )


def test_runs_are_sketched_once(spark):
    """The rows are shuffled, their sketches are not; the results are the same."""
    rows = _rows(spark, 2000)
    found = silver.run_features(silver.gathered(rows))
    assert sorted(found.collect()) == sorted(silver.run_features(rows).collect())
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1


def test_walks_through_a_forest_shuffle_sums_only(spark):
    """The nodes of a forest are broadcast, even where Spark does not know their size."""
    points = spark.range(40, numPartitions=4).select("id", (F.col("id") * 7 % 11).cast("double").alias("a"), (F.col("id") * 5 % 13).cast("double").alias("b"))
    nodes = forest.fit_forest(points, "id", ["a", "b"], trees=5, sample=16).localCheckpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walked = forest.path_scores(points, nodes, "id", ["a", "b"], 16)
        plan = walked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and walked.count() == 40
