"""The feature dictionary and the measurand catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.constants import KPI_FEATURES
from runlens.functions.catalogue import layer_of_feature, layer_of_text, parse_feature_name, squash
from runlens.functions.names import truncate_text

TOP_PRIORITY = 3
NOT_FOUND = "NOT FOUND"
KEY_DETAILS = ("key_type", "data_type", "min_value", "max_value")  # two texts, two numbers


def _pieces(text: Column, lengths: Column) -> Column:
    """Every substring of ``text`` that has one of the given lengths."""
    def starts(n: Column) -> Column:
        count = F.length(text) - n + 1
        return F.transform(F.sequence(F.lit(1), count), lambda i: text.substr(i, n))

    fitting = F.filter(lengths, lambda n: n <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, starts)))


def containment(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (text, term) in which the text contains the term.

    An equi-join on substrings instead of a nested loop: the work grows with the two sides,
    not with their product. A name is short, so the substrings per name are bounded; the
    lengths to cut are one small array, at most as long as the longest term.
    """
    lengths = terms.agg(F.collect_set(F.length("term"))).scalar()
    measured = texts.distinct().withColumn("lengths", lengths)
    cut = F.explode(_pieces(F.col("text"), F.col("lengths")))
    pieces = measured.select("text", cut.alias("term"))
    return pieces.join(terms.distinct(), "term").select("text", "term")


def feature_map(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Features with the first catalogue key whose name contains theirs or is contained in it.

    ``features``: new_var_num, orig_var_name. ``catalogue``: pos, ue_logging, layer_raw, priority,
    key_type, data_type, min_value, max_value. Keys rank by their first position; that row describes the
    key. Unmatched features stay; missing texts are blank.
    """
    parsed = features.withColumns(parse_feature_name(F.col("orig_var_name"))).withColumn(
        "_prefix", squash(F.col("measurand_prefix"))
    )
    keyed = catalogue.withColumn("_key", squash(F.coalesce("ue_logging", F.lit(""))))
    first = keyed.where(F.col("_key") != "").groupBy("_key").agg(
        F.min("pos").alias("pos"),
        F.min_by(F.struct("layer_raw", "priority", *KEY_DETAILS), "pos").alias("row"),
    )
    prefixes, keys = parsed.select("_prefix").distinct(), first.select("_key")
    inside_prefix = containment(
        prefixes.withColumnRenamed("_prefix", "text"), keys.withColumnRenamed("_key", "term")
    ).select(F.col("text").alias("_prefix"), F.col("term").alias("_key"))
    inside_key = containment(
        keys.withColumnRenamed("_key", "text"), prefixes.withColumnRenamed("_prefix", "term")
    ).select(F.col("term").alias("_prefix"), F.col("text").alias("_key"))
    best = (
        inside_prefix.unionByName(inside_key)
        .join(first, "_key")
        .groupBy("_prefix")
        .agg(F.min_by(F.struct("_key", "row"), "pos").alias("_match"))
    )
    matched = parsed.join(best, "_prefix", "left")
    layer = F.col("_match.row.layer_raw")
    return matched.select(
        "new_var_num", "orig_var_name", "measurand_prefix", "feature_type", "feature_value",
        F.col("_match._key").alias("matched_key"),
        layer_of_text(layer).alias("layer_group"),
        F.coalesce(layer, F.lit("")).alias("layer_raw"),
        F.col("_match.row.priority").alias("priority"),
        *[F.coalesce(F.col(f"_match.row.{c}"), F.lit("")).alias(c) for c in KEY_DETAILS[:2]],
        *[F.col(f"_match.row.{c}").alias(c) for c in KEY_DETAILS[2:]],
    )


def priority_features(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Features whose name contains a top-priority key, in numeric order of their id."""
    parsed = features.withColumns(parse_feature_name(F.col("orig_var_name"))).withColumn(
        "text", F.lower("measurand_prefix")
    )
    terms = (
        catalogue.where((F.col("priority") == TOP_PRIORITY) & (F.col("ue_logging") != ""))
        .select(F.lower("ue_logging").alias("term"))
        .distinct()
    )
    hits = containment(parsed.select("text"), terms).select("text").distinct()
    found = parsed.join(hits, "text", "left_semi")
    return found.select("new_var_num", "orig_var_name", "feature_type", "feature_value").orderBy(
        F.expr("try_cast(substr(new_var_num, 2) as bigint)"), "orig_var_name"
    )


def kpi_feature_lookup(features: DataFrame, kpis: dict = KPI_FEATURES) -> DataFrame:
    """Source features of each KPI, ``NOT FOUND`` where the dictionary lacks them."""
    spark = features.sparkSession
    rows = [(k, x) for k, ids in kpis.items() for x in ids if not x.startswith("resolve")]
    wanted = spark.createDataFrame(rows, "kpi string, new_var_num string")
    # The literal list has a dozen ids: keep only their rows before joining them back.
    known = features.where(F.col("new_var_num").isin([x for _, x in rows]))
    return wanted.join(known, "new_var_num", "left").select(
        "kpi", "new_var_num", F.coalesce("orig_var_name", F.lit(NOT_FOUND)).alias("orig_var_name")
    )


def catalogue_rows(catalogue: DataFrame) -> DataFrame:
    """The catalogue under short names, with the layer group and blanks for missing text."""
    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(""))

    return catalogue.select(
        layer_of_text(F.col("layer_raw")).alias("layer_group"),
        text("layer_raw").alias("layer_raw"),
        text("ue_logging").alias("ue_logging"),
        text("meas_key").alias("meas_key"),
        "priority",
        text("key_type").alias("key_type"),
        text("data_type").alias("data_type"),
        "min_value",
        "max_value",
        text("description").alias("description"),
    )


def layer_counts(catalogue: DataFrame) -> DataFrame:
    """Measurands with a key per layer, largest first."""
    counts = catalogue.groupBy(layer_of_text(F.col("layer_raw")).alias("layer_group"))
    return counts.agg(F.count("meas_key").alias("n")).orderBy(F.desc("n"), "layer_group")


def priority_keytype_crosstab(catalogue: DataFrame, key_types: list[str]) -> DataFrame:
    wide = catalogue.groupBy("priority").pivot("key_type", key_types).agg(F.count(F.lit(1)))
    return wide.fillna(0, key_types)


def catalogue_counts(catalogue: DataFrame, features: DataFrame) -> DataFrame:
    """Feature types, priorities and key types counted into one long table."""
    types = feature_type_counts(features).select(
        F.lit("feature_type").alias("counter"), F.col("feature_type").alias("item"), "n"
    )
    both = catalogue.groupingSets([["priority"], ["key_type"]], "priority", "key_type").agg(
        F.grouping("priority").alias("by_type"), F.count("*").alias("n")
    )
    by_type = F.col("by_type") == 1
    return types.unionByName(both.select(
        F.when(by_type, "key_type").otherwise("priority").alias("counter"),
        F.when(by_type, F.col("key_type")).otherwise(F.col("priority").cast("string")).alias("item"),
        "n",
    ))


def layer_priority_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy(layer_of_text(F.col("layer_raw")).alias("layer_group"), "priority").agg(
        F.count("*").alias("n")
    )


def top_measurands(catalogue: DataFrame, k: int = 6) -> DataFrame:
    """First top-priority measurands of each layer, in catalogue order."""
    chosen = catalogue.where((F.col("priority") == TOP_PRIORITY) & (F.col("meas_key") != "")).select(
        layer_of_text(F.col("layer_raw")).alias("layer_group"),
        "pos",
        "meas_key",
        truncate_text(F.col("description")).alias("description"),
    )
    place = F.row_number().over(Window.partitionBy("layer_group").orderBy("pos"))
    return chosen.withColumn("place", place).where(F.col("place") <= k)


def features_by_layer(features: DataFrame) -> DataFrame:
    layer = layer_of_feature(F.col("orig_var_name"))
    return features.groupBy(layer.alias("layer_group")).agg(F.count("*").alias("n"))


def feature_type_counts(features: DataFrame) -> DataFrame:
    kind = parse_feature_name(F.col("orig_var_name"))["feature_type"]
    return features.groupBy(kind.alias("feature_type")).agg(F.count("*").alias("n"))
