"""Telling the classes apart: splits, baselines, Spark ML models, and their measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordinal import running_total
from runlens.operators.random_forest import RandomForest, RandomForestModel, switched

LABEL = "cipher_state"
TRAIN, TEST = ("Tranche_B",), ("Tranche_A", "Tranche_C")
# Settings of the planned models. 30 is the depth that Spark ML allows.
MAX_ITER, INVERSE_PENALTY = 1000, 1.0
TREES, DEPTH = 200, 30
NODES_MB = 64  # counts of the nodes that are split in one pass, in a task


def split_tranches(
    df: DataFrame, train: Sequence[str] = TRAIN, test: Sequence[str] = TEST
) -> DataFrame:
    """Mark each run as train or test by its tranche; others are left out."""
    part = F.when(F.col("tranche").isin(*train), "train").when(F.col("tranche").isin(*test), "test")
    return df.withColumn("part", part).where(F.col("part").isNotNull())


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.when(F.col(LABEL) == "on", 1.0).otherwise(0.0))


def assembler(features: Sequence[str]) -> Pipeline:
    """Missing values to the mean, features into one scaled vector."""
    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
    ])


def assemble(df: DataFrame, features: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Scaled vectors; scale and fill values come from ``fitted_on`` alone."""
    model = assembler(features).fit(df if fitted_on is None else fitted_on)
    return with_target(model.transform(df)).drop("raw_features", *[f"{f}_filled" for f in features])


def fit_logistic(train: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Logistic regression with an L2 penalty of the usual 1 / (C n)."""
    penalty = 1.0 / (INVERSE_PENALTY * max(train.count(), 1))
    model = LogisticRegression(
        labelCol="target", maxIter=MAX_ITER, regParam=penalty, standardization=False, tol=1e-10
    )
    return Pipeline(stages=[assembler(features), model]).fit(with_target(train))


def fit_random_forest(
    train: DataFrame, features: Sequence[str], trees: int = TREES, depth: int = DEPTH, seed: int = 42
) -> PipelineModel:
    """Every tree is grown by one task, from a byte per run and feature; neither runs nor trees pass the driver (``random_forest``)."""
    model = RandomForest(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=NODES_MB)
    return Pipeline(stages=[assembler(features), model]).fit(with_target(train))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns with the probability of on and the predicted class."""
    scored = model.transform(df)
    return scored.select(
        *keep,
        vector_to_array("probability")[1].alias("score"),
        F.when(F.col("prediction") == 1, "on").otherwise("off").alias("predicted"),
    )


def _per_feature(df: DataFrame, features: Sequence[str], values: Sequence[float], name: str) -> DataFrame:
    """Model numbers as rows; there is one per feature."""
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, f"feature string, {name} double")


def coefficients(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Signed coefficients, largest magnitude first."""
    table = _per_feature(df, features, model.stages[-1].coefficients.toArray(), "coefficient")
    return table.orderBy(F.desc(F.abs("coefficient")))


def importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    table = _per_feature(df, features, model.stages[-1].featureImportances.toArray(), "importance")
    return table.orderBy(F.desc("importance"))


def _value_counts(df: DataFrame, value: str) -> DataFrame:
    """Runs of each class per distinct value: the only rows that get ordered."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(F.col(LABEL) == "on").alias("n_on"),
        F.count_if(F.col(LABEL) == "off").alias("n_off"),
    )


def threshold_baseline(df: DataFrame, value: str) -> DataFrame:
    """The single cut on one feature that classifies most runs right.

    With S the running sum of on minus off up to a value, calling everything above it on is
    right for all-on minus S runs, calling everything up to it on for all-off plus S.
    """
    counts = _value_counts(df, value)
    lead = running_total(counts, [], [value], F.col("n_on") - F.col("n_off"), "lead")
    totals = counts.agg(F.sum("n_on").alias("on"), F.sum("n_off").alias("off"))
    on, off = totals.select("on").scalar(), totals.select("off").scalar()
    known = lead.withColumns({"on": on, "off": off})
    cuts = known.select(
        F.col(value).alias("threshold"),
        (F.col("on") + F.col("off")).alias("n"),
        F.inline(F.array(
            F.struct(F.lit("above").alias("on_side"), (F.col("on") - F.col("lead")).alias("n_right")),
            F.struct(F.lit("up to").alias("on_side"), (F.col("off") + F.col("lead")).alias("n_right")),
        )),
    )
    best = F.min_by(
        F.struct("threshold", "on_side", "n_right", "n"),
        F.struct(-F.col("n_right"), "threshold", "on_side"),
    )
    return cuts.agg(best.alias("b")).select(
        "b.threshold", "b.on_side", (F.col("b.n_right") / F.col("b.n")).alias("accuracy")
    )


def auc(df: DataFrame, score: str, positive: str = "on") -> DataFrame:
    """Area under the ROC curve: the share of pairs ranked right, ties counting half.

    Pairs are never formed; each distinct score needs only the negatives up to it.
    """
    up, down = ("n_on", "n_off") if positive == "on" else ("n_off", "n_on")
    counts = _value_counts(df, score)
    ranked = running_total(counts, [], [score], F.col(down), "upto")
    won = F.col(up) * (F.col("upto") - F.col(down) / 2)
    pairs = F.sum(up).cast("double") * F.sum(down)
    return ranked.agg(
        F.try_divide(F.sum(won), pairs).alias("auc"),
        F.sum(up).alias("n_positive"),
        F.sum(down).alias("n_negative"),
    )


def accuracy(predictions: DataFrame, *keys: str) -> DataFrame:
    right = F.count_if(F.col("predicted") == F.col(LABEL))
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), (right / F.count("*")).alias("accuracy")
    )


def detection_rates(df: DataFrame, flagged: Column, anomalous: str = "off") -> DataFrame:
    """Share of anomalous runs that are flagged, and of normal runs that are."""
    hit = F.when(flagged, 1.0).otherwise(0.0)
    bad = F.col(LABEL) == anomalous
    return df.agg(
        F.avg(F.when(bad, hit)).alias("detection_rate"),
        F.avg(F.when(~bad, hit)).alias("false_alarm_rate"),
    )


def logistic_gradient(model: PipelineModel, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature the gradient of the penalised mean loss at the fitted coefficients: zero at the optimum."""
    fitted = model.stages[-1]
    scored = model.transform(with_target(train)).select(
        vector_to_array("features").alias("v"), (vector_to_array("probability")[1] - F.col("target")).alias("gap")
    )
    sums = scored.agg(*[F.avg(F.col("v")[i] * F.col("gap")).alias(f"g{i}") for i in range(len(features))])
    penalty = fitted.getRegParam()
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col(f"g{i}") + penalty * float(fitted.coefficients[i])).alias("gradient"))
        for i, f in enumerate(features)
    ])
    return sums.select(F.inline(rows))


def evaluate(predictions: DataFrame) -> DataFrame:
    """Per tranche: runs, accuracy, and the area under the ROC curve of the score (null where a class is absent)."""
    counts = predictions.groupBy("tranche", "score").agg(
        F.count_if(F.col(LABEL) == "on").alias("n_on"), F.count_if(F.col(LABEL) == "off").alias("n_off")
    )
    ranked = running_total(counts, ["tranche"], ["score"], F.col("n_off"), "upto")
    won = F.sum(F.col("n_on") * (F.col("upto") - F.col("n_off") / 2))
    areas = ranked.groupBy("tranche").agg(F.try_divide(won, F.sum("n_on").cast("double") * F.sum("n_off")).alias("auc"))
    return accuracy(predictions, "tranche").join(areas, "tranche")


def shapley_importance(
    model: PipelineModel,
    df: DataFrame,
    run: str,
    features: Sequence[str],
    samples: int = 16,
    seed: int = 42,
) -> DataFrame:
    """Mean absolute Shapley value per feature; see ``shapley_values``."""
    values = shapley_values(model, df, run, features, samples, seed)
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


def shapley_values(
    model: PipelineModel,
    df: DataFrame,
    run: str,
    features: Sequence[str],
    samples: int = 16,
    seed: int = 42,
) -> DataFrame:
    """Shapley value per run and feature, by sampled permutations. A run's values add up to its score minus the background's mean.

    The standard error of a value falls with the square root of ``samples``; the sum is exact for any number.

    For each run and sample, features switch one by one, in random order, from a background
    run's values to the run's own. Each step's score counts for the feature just switched and
    against the next one, so contributions are sums: no ordering of scores is needed. A forest of
    ``random_forest`` is not scored at every step, its trees are walked once for all of them. The
    background is ``samples`` runs, a fixed number, and is broadcast.
    """
    d = len(features)
    vectors = model.stages[0].transform(df).select(run, vector_to_array("features").alias("own"))
    background = (
        vectors.select(F.xxhash64(F.col(run), F.lit(seed)).alias("draw"), "own")
        .orderBy("draw")
        .limit(samples)
        .agg(F.array_sort(F.collect_list(F.struct("draw", "own"))).alias("all"))
        .where(F.size("all") > 0)
        .select("all", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
        .select("k", F.get("all", F.col("k") % F.size("all"))["own"].alias("base"))  # fewer runs than samples: in turn
    )
    places = F.sequence(F.lit(0), F.lit(d - 1))
    draws = F.transform(places, lambda i: F.struct(F.xxhash64(F.col(run), "k", i, F.lit(seed)).alias("draw"), i.alias("i")))
    drawn = (
        vectors.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .join(F.broadcast(background), "k")
    )
    names = F.array(*[F.lit(f) for f in features])
    if isinstance(model.stages[-1], RandomForestModel):  # its leaves say at which steps its score changes
        gained = switched(model.stages[-1], drawn.withColumn("draws", F.transform(draws, lambda s: s["draw"])), run)
        sums = gained.groupBy(run).agg(F.array(*[F.sum(F.get("values", F.lit(i))) / samples for i in range(d)]).alias("values"))
        return sums.select(run, F.inline(F.arrays_zip(names.alias("feature"), F.col("values").alias("value"))))
    drawn = drawn.withColumn("order", F.transform(F.array_sort(draws), lambda s: s["i"]))
    ranked = drawn.withColumn("ranks", F.transform(places, lambda i: F.array_position("order", i) - 1))
    steps = ranked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumn(
        "pairs", F.arrays_zip("own", "base", "ranks")
    )
    mixed = F.transform(
        "pairs", lambda p: F.when(p["ranks"] < F.col("step"), p["own"]).otherwise(p["base"])
    )
    scored = model.stages[-1].transform(
        steps.select(run, "step", "order", array_to_vector(mixed).alias("features"))
    ).select(run, "step", "order", (vector_to_array("probability")[1] / samples).alias("p"))
    credits = scored.select(run, F.inline(F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("place"), F.col("p").alias("part")),
        F.struct(F.get("order", F.col("step")).alias("place"), (-F.col("p")).alias("part")),
    ))).where(F.col("place").isNotNull())
    values = credits.groupBy(run, "place").agg(F.sum("part").alias("value"))
    return values.select(run, F.get(names, F.col("place")).alias("feature"), "value")
