"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Each tree sees at most ``sample`` rows, so growing is one small group per tree and the whole
forest is at most ``trees * (2 * sample - 1)`` nodes: a proven bound for its broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREES, SAMPLE = 200, 256
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, depth int, size int"
)
_EULER = 0.5772156649015329


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a search among n points ends."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3.0)
    depth = 2.0 * (np.log(many - 1.0) + _EULER) - 2.0 * (many - 1.0) / many
    return np.where(n > 2, depth, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, tree: int, seed: int, max_depth: int) -> pd.DataFrame:
    random = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    waiting = [(points, 0, None, None)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        here = len(nodes)
        nodes.append([tree, here, -1, 0.0, -1, -1, depth, len(rows)])
        if parent is not None:
            nodes[parent][side] = here
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or usable.size == 0:
            continue
        feature = int(random.choice(usable))
        threshold = float(random.uniform(low[feature], high[feature]))
        nodes[here][2:4] = feature, threshold
        below = rows[:, feature] <= threshold
        waiting += [(rows[~below], depth + 1, here, 5), (rows[below], depth + 1, here, 4)]
    columns = ["tree", "node", "feature", "threshold", "left", "right", "depth", "size"]
    return pd.DataFrame(nodes, columns=columns)


def fit_forest(
    df: DataFrame,
    run: str,
    features: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """Node table of the forest. Rows choose their trees by hash, before any shuffle."""
    n = df.count()
    rate = min(1.0, (sample + 8.0 * math.sqrt(sample)) / max(n, 1))
    scale = 1 << 30

    def draw(tree):
        return F.pmod(F.xxhash64(F.col(run), tree, F.lit(seed)), F.lit(scale))

    own_trees = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.lit(rate * scale)
    )
    drawn = df.select(
        run, F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.explode(own_trees).alias("tree"),
    ).withColumn("draw", draw(F.col("tree")))
    order = Window.partitionBy("tree").orderBy("draw", run)
    sampled = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    max_depth = math.ceil(math.log2(max(min(sample, n), 2)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        points = np.array(group.sort_values("place")["x"].tolist(), dtype=float)
        return _grow(points, int(group["tree"].iloc[0]), seed, max_depth)

    return sampled.select("tree", "place", "x").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score_forest(
    df: DataFrame, nodes: DataFrame, features: Sequence[str], sample: int = SAMPLE
) -> DataFrame:
    """Add ``score``: the lower, the more anomalous; about zero marks the usual cut."""
    forest = nodes.toPandas()
    packed = []
    for _, tree in forest.sort_values(["tree", "node"]).groupby("tree"):
        ends = tree["depth"].to_numpy() + mean_path(tree["size"].to_numpy())
        packed.append((
            tree["feature"].to_numpy(), tree["threshold"].to_numpy(),
            tree["left"].to_numpy(), tree["right"].to_numpy(), ends,
        ))
    used = int(forest.loc[forest["node"] == 0, "size"].max())
    shared = df.sparkSession.sparkContext.broadcast((packed, float(mean_path(used)), int(forest["depth"].max())))
    names = list(features)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, normal, depth = shared.value
        for batch in batches:
            points = batch[names].to_numpy(dtype=float)
            total = np.zeros(len(batch))
            for feature, threshold, left, right, ends in trees:
                at = np.zeros(len(batch), dtype=np.int64)
                for _ in range(depth):
                    split = feature[at]
                    below = points[np.arange(len(batch)), np.maximum(split, 0)] <= threshold[at]
                    at = np.where(split < 0, at, np.where(below, left[at], right[at]))
                total += ends[at]
            mean = total / len(trees)
            yield batch.assign(score=0.5 - np.power(2.0, -mean / normal))

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInPandas(score, schema)


def path_scores(df: DataFrame, nodes: DataFrame, run: str, features: Sequence[str], sample: int = SAMPLE) -> DataFrame:
    """Rows (run, score): the scores of ``score_forest``, by joining runs to nodes level by level.

    All trees of a run are walked at once; a walk ends where it is at a leaf. It is the plain form, for a check. The nodes are
    broadcast, within the bound of a forest; runs times trees are never shuffled, only their sums are.
    """
    inner = F.broadcast(nodes.select("tree", "node", "feature", "threshold", "left", "right"))
    deepest, used = nodes.agg(F.max("depth"), F.max(F.when(F.col("node") == 0, F.col("size")))).first()
    at = df.select(run, F.array(*[F.col(f).cast("double") for f in features]).alias("x")).join(F.broadcast(nodes.where("node = 0").select("tree", "node")))
    for _ in range(deepest or 0):
        below = F.get("x", F.greatest("feature", F.lit(0))) <= F.col("threshold")
        step = F.when(F.col("feature") < 0, F.col("node")).when(below, F.col("left")).otherwise(F.col("right"))
        at = at.join(inner, ["tree", "node"]).select(run, "x", "tree", step.alias("node"))
    n = F.col("size").cast("double")
    usual = 2 * (F.log(n - 1) + _EULER) - 2 * (n - 1) / n
    ends = F.col("depth") + F.when(n > 2, usual).when(n == 2, 1.0).otherwise(0.0)
    found = at.join(F.broadcast(nodes.select("tree", "node", "depth", "size")), ["tree", "node"]).groupBy(run).agg(F.avg(ends).alias("mean"))
    return found.select(run, (0.5 - F.pow(F.lit(2.0), -F.col("mean") / float(mean_path(used or 1)))).alias("score"))


def checked_trees(nodes: DataFrame) -> DataFrame:
    """Per tree: the rows at its root, and whether those of every split are those of its children."""
    side = {s: nodes.select("tree", F.col("node").alias(s), F.col("size").alias(f"{s}_size")) for s in ("left", "right")}
    joined = nodes.join(side["left"], ["tree", "left"], "left").join(side["right"], ["tree", "right"], "left")
    return joined.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).cast("bigint").alias("root_rows"),
        F.every((F.col("feature") < 0) | (F.col("size") == F.col("left_size") + F.col("right_size"))).alias("rows_add_up"),
    )
