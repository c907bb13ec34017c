"""Models over the run table."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from runlens.operators import compare, forest, models, shapley, silver
from runlens.plans.queries.measurements import SILVER_SQL
from runlens.plans.queries.runs import histogram_sql
from runlens.plans.registry import Tables, query, rounded
from runlens.plans.views import ML, NATIVE
from runlens.session import materialize

ML_SQL = ML.sql()
FEATURES = [name for f in silver.FEATURES for name in f.names()]  # all 68 of Silver
KEEP = ["run_id", "tranche", "cipher_state"]


def _silver(load: Tables):
    """Runs are few bytes and much work: they are dealt out over the cores."""
    return materialize(silver.run_features(silver.gathered(load(NATIVE))).repartition(load.spark.sparkContext.defaultParallelism, "run_id"))


@query("ml_split_tranche", f"""select run_id, case tranche when 'Tranche_B' then 'train' else 'test' end as part
 from {ML_SQL} where tranche in ('Tranche_A', 'Tranche_B', 'Tranche_C')""")
def ml_split_tranche(load: Tables):
    return models.split_tranches(load(ML)).select("run_id", "part")


def _parts(load: Tables):
    runs = models.split_tranches(_silver(load))
    return runs.where("part = 'train'"), runs.where("part = 'test'")


@query("ml_assemble", "select run_id, target, " + ", ".join(
    f"round(case when stddev_samp(x{i}) over () = 0 then 0e0 else (x{i} - avg(x{i}) over ()) / stddev_samp(x{i}) over () end, 5) as {f}"
    for i, f in enumerate(FEATURES)
) + f""" from (select run_id, case cipher_state when 'on' then 1.0e0 else 0.0e0 end as target,
 {', '.join(f'coalesce({f}, avg({f}) over ()) as x{i}' for i, f in enumerate(FEATURES))} from {SILVER_SQL})""")
def ml_assemble(load: Tables):
    vectors = models.assemble(_silver(load), FEATURES).withColumn("v", vector_to_array("features"))
    return rounded(vectors.select(
        "run_id", "target", *[F.col("v")[i].alias(f) for i, f in enumerate(FEATURES)]
    ), 5, *FEATURES)


@query("ml_threshold_baseline", f"""with c as (select bler_mean as x, count(*) filter (where cipher_state = 'on') as a,
  count(*) filter (where cipher_state = 'off') as b from {ML_SQL} group by 1),
 r as (select x, sum(a - b) over (order by x) as s, sum(a) over () as ta, sum(b) over () as tb from c)
 select x as threshold, side as on_side, right_ / (ta + tb) as accuracy from (
  select x, 'above' as side, ta - s as right_, ta, tb from r union all select x, 'up to', tb + s, ta, tb from r)
 order by right_ desc, x, side limit 1""")
def ml_threshold_baseline(load: Tables):
    return models.threshold_baseline(load(ML), "bler_mean")


@query("ml_logistic")
def ml_logistic(load: Tables):
    train, test = _parts(load)
    model = models.fit_logistic(train, FEATURES)
    return models.predict(model, test, KEEP)


@query("ml_coefficients")
def ml_coefficients(load: Tables):
    train, _ = _parts(load)
    return models.coefficients(models.fit_logistic(train, FEATURES), train, FEATURES)


@query("ml_random_forest")
def ml_random_forest(load: Tables):
    train, test = _parts(load)
    model = models.fit_random_forest(train, FEATURES)
    return models.predict(model, test, KEEP)


@query("ml_feature_importances")
def ml_feature_importances(load: Tables):
    train, _ = _parts(load)
    return models.importances(models.fit_random_forest(train, FEATURES), train, FEATURES)


@query("ml_logistic_optimum", "select unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) as feature, true as at_optimum")
def ml_logistic_optimum(load: Tables):
    """What the fit determines: the penalised gradient is zero for every feature."""
    train, _ = _parts(load)
    gradient = models.logistic_gradient(models.fit_logistic(train, FEATURES), train, FEATURES)
    return gradient.select("feature", (F.abs("gradient") < 1e-6).alias("at_optimum"))


@query("ml_evaluation")
def ml_evaluation(load: Tables):
    """Accuracy and AUC of the fitted models on the tranches that they have not seen."""
    train, test = _parts(load)
    fitted = {"logistic": models.fit_logistic(train, FEATURES), "forest": models.fit_random_forest(train, FEATURES)}
    parts = [
        models.evaluate(materialize(models.predict(model, test, KEEP))).withColumn("model", F.lit(name))
        for name, model in fitted.items()
    ]
    return parts[0].unionByName(parts[1])


@query("ml_shap_importance")
def ml_shap_importance(load: Tables):
    """Of the forest; exact, over a background of test runs."""
    train, test = _parts(load)
    explained = shapley.forest_shapley(models.fit_random_forest(train, FEATURES), test, "run_id")
    return shapley.importance(explained, FEATURES)


# A small forest with given nodes: (tree, node, feature, threshold, left, right, value).
SMALL_FEATURES = ("bler_mean", "retx_mean", "mcs_mean")
SMALL_FOREST = (
    (0, 0, 0, 0.051, 1, 2, None), (0, 1, 1, 0.04, 3, 4, None), (0, 2, -1, None, -1, -1, 0.4), (0, 3, -1, None, -1, -1, 0.1), (0, 4, -1, None, -1, -1, 0.7),
    (1, 0, 2, 25.5, 1, 2, None), (1, 1, -1, None, -1, -1, 0.2), (1, 2, 0, 0.0505, 3, 4, None), (1, 3, -1, None, -1, -1, 0.9), (1, 4, -1, None, -1, -1, 0.3),
    (2, 0, 1, 0.0402, 1, 2, None), (2, 1, 1, 0.0398, 3, 4, None), (2, 2, -1, None, -1, -1, 0.8), (2, 3, -1, None, -1, -1, 0.15), (2, 4, -1, None, -1, -1, 0.55),
)
SMALL_BACKGROUND = 64


def _mixed_sql(feature: int) -> str:
    name = SMALL_FEATURES[feature]
    return f"case when (s.mask >> {feature}) & 1 = 1 then x.{name} else b.{name} end"


def _tree_sql(tree: int, node: int = 0) -> str:
    _, _, feature, threshold, left, right, value = next(r for r in SMALL_FOREST if r[:2] == (tree, node))
    if left < 0:
        return f"{value}e0"
    return f"case when {_mixed_sql(feature)} <= {threshold}e0 then {_tree_sql(tree, left)} else {_tree_sql(tree, right)} end"


# The definition: over all sets of features, with the weights of three features.
SMALL_SHAP_SQL = f"""(with b as (select * from {ML_SQL} order by run_id limit {SMALL_BACKGROUND}),
 v as (select x.run_id, s.mask, avg(({' + '.join(_tree_sql(t) for t in range(3))}) / 3) as v
  from {ML_SQL} x cross join b cross join (select unnest(range(8)) as mask) s group by 1, 2)
 {' union all '.join(
     f"select p.run_id, '{name}' as feature, sum((q.v - p.v) * case bit_count(p.mask) when 1 then 1e0 / 6 else 1e0 / 3 end) as value"
     f" from v p join v q on q.run_id = p.run_id and q.mask = p.mask + {1 << i} where (p.mask >> {i}) & 1 = 0 group by 1"
     for i, name in enumerate(SMALL_FEATURES))})"""


def _explained_small(load: Tables):
    runs = load(ML).select("run_id", F.array(*SMALL_FEATURES).alias("own"))
    nodes = load.spark.createDataFrame(list(SMALL_FOREST), "tree int, node int, feature int, threshold double, left int, right int, value double")
    return shapley.explain(runs, "run_id", shapley.forest_leaves(nodes), runs.orderBy("run_id").limit(SMALL_BACKGROUND), 3)


@query("ml_tree_shap", f"select run_id, feature, round(value, 9) + 0e0 as value from {SMALL_SHAP_SQL}")
def ml_tree_shap(load: Tables):
    """Exact Shapley values of a given forest, per run and feature."""
    values = shapley.values_by_feature(_explained_small(load), "run_id", SMALL_FEATURES)
    return values.withColumn("value", F.round("value", 9) + F.lit(0.0))


@query("ml_tree_shap_importance", f"select feature, round(avg(abs(value)), 9) as importance from {SMALL_SHAP_SQL} group by 1")
def ml_tree_shap_importance(load: Tables):
    return rounded(shapley.importance(_explained_small(load), SMALL_FEATURES), 9, "importance")


@query("ml_forest_nodes", f"select unnest(range({models.TREES}))::integer as tree, true as rows_add_up, true as impurity_fits, true as gain_fits")
def ml_forest_nodes(load: Tables):
    """What the fitted forest's node table determines of itself."""
    train, _ = _parts(load)
    return shapley.checked_nodes(shapley.forest_nodes(models.fit_random_forest(train, FEATURES)))


@query("ml_forest_scores", f"select run_id, true as same_score, true as adds_up from {SILVER_SQL} where tranche in ('Tranche_A', 'Tranche_C')")
def ml_forest_scores(load: Tables):
    """The model's scores from its node table; and the exact Shapley values of all 68 features add up to them."""
    train, test = _parts(load)
    model = models.fit_random_forest(train, FEATURES)
    explained = shapley.forest_shapley(model, test, "run_id")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    scores = models.predict(model, test, ["run_id"]).withColumnRenamed("score", "known")
    return explained.join(scores, "run_id").select(
        "run_id", (F.abs(F.col("score") - F.col("known")) < 1e-12).alias("same_score"),
        (F.abs(total - F.col("score") + F.col("base")) < 1e-9).alias("adds_up"),
    )


@query("ml_logistic_scores", f"select run_id, true as same_score from {SILVER_SQL} where tranche in ('Tranche_A', 'Tranche_C')")
def ml_logistic_scores(load: Tables):
    """The model's scores from its table of coefficients."""
    train, test = _parts(load)
    model = models.fit_logistic(train, FEATURES)
    weights = models.coefficients(model, train, FEATURES)
    vectors = model.transform(test).select("run_id", vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("known"))
    names = F.array(*[F.lit(f) for f in FEATURES])
    long = vectors.select("run_id", "known", F.inline(F.arrays_zip(names.alias("feature"), F.col("x").alias("v"))))
    sums = long.join(weights, "feature").groupBy("run_id", "known").agg(F.sum(F.col("v") * F.col("coefficient")).alias("z"))
    score = 1 / (1 + F.exp(-F.col("z") - model.stages[-1].intercept))
    return sums.select("run_id", (F.abs(score - F.col("known")) < 1e-9).alias("same_score"))


@query("ml_shap_sums", f"select run_id, true as adds_up from {SILVER_SQL} where tranche in ('Tranche_A', 'Tranche_C')")
def ml_shap_sums(load: Tables):
    """What Shapley values determine: for each run they add up to its score minus the background's mean score."""
    train, test = _parts(load)
    model = models.fit_random_forest(train, FEATURES)
    sums = models.shapley_values(model, test, "run_id", FEATURES).groupBy("run_id").agg(F.sum("value").alias("total"))
    gaps = materialize(models.predict(model, test, ["run_id"]).join(sums, "run_id").select("run_id", (F.col("score") - F.col("total")).alias("base")))
    base = gaps.agg(F.avg("base")).scalar()
    return gaps.select("run_id", (F.abs(F.col("base") - base) < 1e-9).alias("adds_up"))


def _scored(load: Tables):
    runs = _silver(load).select(*KEEP, *FEATURES)
    nodes = forest.fit_forest(runs.where("cipher_state = 'on'"), "run_id", FEATURES)
    return forest.score_forest(runs, nodes, FEATURES)


@query("ml_isolation_forest")
def ml_isolation_forest(load: Tables):
    return _scored(load).select("run_id", "cipher_state", "score")


ON_RUNS_SQL = f"(select count(*) from {SILVER_SQL} where cipher_state = 'on')"


@query("ml_isolation_trees", f"""select unnest(range({forest.TREES}))::integer as tree, least({forest.SAMPLE}, {ON_RUNS_SQL})::bigint as root_rows,
 true as rows_add_up""")
def ml_isolation_trees(load: Tables):
    """What the trees determine: the runs at their roots, and that splits keep all of them."""
    runs = _silver(load).where("cipher_state = 'on'")
    return forest.checked_trees(materialize(forest.fit_forest(runs, "run_id", FEATURES)))


@query("ml_isolation_paths", f"select run_id, true as same_score from {SILVER_SQL}")
def ml_isolation_paths(load: Tables):
    """Scores from the stored node table, walked level by level with joins."""
    runs = _silver(load).select(*KEEP, *FEATURES)
    nodes = materialize(forest.fit_forest(runs.where("cipher_state = 'on'"), "run_id", FEATURES))
    known = forest.score_forest(runs, nodes, FEATURES).select("run_id", F.col("score").alias("known"))
    walked = forest.path_scores(runs, nodes, "run_id", FEATURES)
    return walked.join(known, "run_id").select("run_id", (F.abs(F.col("score") - F.col("known")) < 1e-12).alias("same_score"))


@query("ml_isolation_histogram")
def ml_isolation_histogram(load: Tables):
    return compare.histogram(_scored(load), "score", 40)


@query("ml_auc", f"""with c as (select bler_mean as x, count(*) filter (where cipher_state = 'on') as a,
  count(*) filter (where cipher_state = 'off') as b from {ML_SQL} group by 1),
 r as (select a, b, sum(b) over (order by x) as upto from c)
 select round(sum(a * (upto - b / 2)) / (cast(sum(a) as double) * sum(b)), 9) as auc,
 cast(sum(a) as bigint) as n_positive, cast(sum(b) as bigint) as n_negative from r""")
def ml_auc(load: Tables):
    return rounded(models.auc(load(ML), "bler_mean"), 9, "auc")


def _thresholded(load: Tables):
    cut = F.when(F.col("bler_mean") > 0.051, "on").otherwise("off")
    return load(ML).withColumn("predicted", cut)


@query("ml_accuracy", f"""select tranche, count(*) as n, count(*) filter (where cipher_state =
 case when bler_mean > 0.051 then 'on' else 'off' end) / count(*) as accuracy from {ML_SQL} group by 1""")
def ml_accuracy(load: Tables):
    return models.accuracy(_thresholded(load), "tranche")


@query("ml_detection_rates", f"""select avg(case when bler_mean <= 0.051 then 1e0 else 0e0 end) filter (where cipher_state = 'off')
 as detection_rate, avg(case when bler_mean <= 0.051 then 1e0 else 0e0 end) filter (where cipher_state <> 'off')
 as false_alarm_rate from {ML_SQL}""")
def ml_detection_rates(load: Tables):
    return models.detection_rates(load(ML), F.col("bler_mean") <= 0.051)


SCORED_SQL = f"(select cipher_state, -abs(bler_mean - 0.05) as score from {ML_SQL})"


@query("ml_score_histogram", histogram_sql(SCORED_SQL, "score", 40))
def ml_score_histogram(load: Tables):
    scored = load(ML).select("cipher_state", (-F.abs(F.col("bler_mean") - 0.05)).alias("score"))
    return compare.histogram(scored, "score", 40)
