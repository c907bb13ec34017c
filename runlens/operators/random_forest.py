"""Random forests of two classes (Breiman 2001), a tree grown by one task.

The rows are stored with a byte per feature, the bin of its value, as Spark ML bins them too. A task reads these bytes and grows its
trees one by one, a level of a tree at a time: rows keep their nodes, and the counts of a level's nodes are made in passes of bounded size.
Grown trees are stored as rows, a row per node, and read again file by file to score. So no tree, and no row, passes the driver,
and no counts are shuffled. A task holds the bytes of all rows (about 70 a row with 68 features) and one tree.

The rows are put in the order of their bytes first, so the forest does not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch_path
from runlens.sources.files import located, n_tasks, root_uri

BINS = 32
SWITCHED = 8192  # rows that pass a tree at once, feature by feature
NODES = (
    "tree int, node int, feature int, threshold double, left int, right int, value double, off_rows double, on_rows double,"
    " impurity double, gain double"
)


def part_files(uri: str) -> list[str]:
    """The stored files of a table in a folder, in order of their names."""
    filesystem, path = located(uri)
    found = filesystem.get_file_info(pyarrow.fs.FileSelector(path))
    return sorted(uri.rstrip("/") + "/" + f.base_name for f in found if f.base_name.endswith(".parquet"))


def read_part(uri: str, columns: list[str] | None = None):
    filesystem, path = located(uri)
    return pq.read_table(path, columns=columns, filesystem=filesystem, partitioning=None)


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts between distinct values, into bins of about equally many: the rule of Spark ML, over all values."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < bins:
        return middles
    upto, stride, chosen, last = np.cumsum(counts), len(values) / bins, [], -1
    nearer = upto[:-1] + upto[1:]  # beyond twice the target: the value before is nearer to it
    for i in range(1, bins):
        at = max(int(np.searchsorted(nearer, 2 * stride * i, side="right")), last + 1)
        if at >= len(middles):
            break
        chosen.append(at)
        last = at
    return middles[chosen]


def _gini(off: np.ndarray, on: np.ndarray) -> np.ndarray:
    n = off + on
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, 1.0 - (off / n) ** 2 - (on / n) ** 2, 0.0)


def grow(codes: np.ndarray, on: np.ndarray, weights: np.ndarray, cuts: list[np.ndarray], tree: int, random: np.random.Generator, depth: int, memory: int) -> pd.DataFrame:
    """The nodes of one tree: best cut by Gini of a fresh draw of sqrt(features) at each node; equal siblings are made one leaf."""
    kept = np.flatnonzero(weights)
    codes, on, weights = codes[kept], on[kept], weights[kept].astype(float)
    n_features = codes.shape[1]
    drawn, bins = math.ceil(math.sqrt(n_features)), max(len(c) for c in cuts) + 1
    n_cuts = np.array([len(c) for c in cuts])
    per_pass = max(1, (memory << 20) // (drawn * bins * 16))
    size = [np.array([weights[~on].sum()]), np.array([weights[on].sum()])]
    levels: list[dict[str, np.ndarray]] = [{"off": size[0], "on": size[1]}]
    first, active = 0, np.flatnonzero((size[0] > 0) & (size[1] > 0))  # number of the level's first node; its nodes that may be split
    row, at = np.arange(len(kept)), np.zeros(len(kept), np.int64)  # rows of such nodes, and their places among them
    if not len(active):
        row, at = row[:0], at[:0]
    for level in range(depth + 1):
        here = levels[-1]
        n_here = len(here["off"])
        here |= {
            "feature": np.full(n_here, -1), "bin": np.zeros(n_here, np.int64), "left": np.full(n_here, -1), "right": np.full(n_here, -1), "gain": np.full(n_here, -1.0),
        }
        if level == depth or not len(active):
            break
        n_active = len(active)
        tried = np.argsort(random.random((n_active, n_features)), axis=1)[:, :drawn]
        best = np.zeros(n_active, np.int64)
        gain = np.full(n_active, -np.inf)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for a in range(0, n_active, per_pass):
            b = min(a + per_pass, n_active)
            own = slice(*np.searchsorted(at, [a, b]))
            place = (at[own] - a)[:, None] * drawn + np.arange(drawn)
            key = (place * bins + codes[row[own][:, None], tried[at[own]]]).ravel()
            of_on = np.where(on[row[own]], weights[row[own]], 0.0)
            shape = ((b - a), drawn, bins)
            all_rows = np.bincount(key, np.repeat(weights[row[own]], drawn), math.prod(shape)).reshape(shape).cumsum(axis=2)
            on_rows = np.bincount(key, np.repeat(of_on, drawn), math.prod(shape)).reshape(shape).cumsum(axis=2)
            n, n_on = all_rows[:, :1, -1:], on_rows[:, :1, -1:]
            left, right = all_rows, n - all_rows
            gains = _gini(n - n_on, n_on) - left / n * _gini(left - on_rows, on_rows) - right / n * _gini(right - n_on + on_rows, n_on - on_rows)
            usable = (left > 0) & (right > 0) & (np.arange(bins) < n_cuts[tried[a:b]][:, :, None])
            gains = np.where(usable, gains, -np.inf).reshape(b - a, -1)
            best[a:b] = gains.argmax(axis=1)
            gain[a:b] = gains[np.arange(b - a), best[a:b]]
        split = gain > 0
        chosen = active[split]
        feature, cut = tried[np.arange(n_active), best // bins][split], best[split] % bins
        here["feature"][chosen], here["bin"][chosen], here["gain"][chosen] = feature, cut, gain[split]
        below = first + n_here
        here["left"][chosen], here["right"][chosen] = below + 2 * np.arange(len(chosen)), below + 2 * np.arange(len(chosen)) + 1
        if not len(chosen):
            break
        place = np.cumsum(split) - 1
        stays = split[at]
        row, parent = row[stays], place[at[stays]]
        child = 2 * parent + (codes[row, feature[parent]] > cut[parent])
        off_rows = np.bincount(child, np.where(on[row], 0.0, weights[row]), 2 * len(chosen))
        on_rows = np.bincount(child, np.where(on[row], weights[row], 0.0), 2 * len(chosen))
        levels.append({"off": off_rows, "on": on_rows})
        mixed = (off_rows > 0) & (on_rows > 0)
        first, active = below, np.flatnonzero(mixed)
        place = np.cumsum(mixed) - 1
        stays = mixed[child]
        row, at = row[stays], place[child[stays]]
    nodes = pd.DataFrame({name: np.concatenate([x[name] for x in levels]) for name in ("off", "on", "feature", "bin", "left", "right", "gain")})
    return _pruned(nodes, [len(x["off"]) for x in levels], cuts, tree)


def _pruned(nodes: pd.DataFrame, sizes: list[int], cuts: list[np.ndarray], tree: int) -> pd.DataFrame:
    """Siblings that are leaves and predict one class are taken back, from the deepest level on, as Spark ML does; then nodes are numbered anew."""
    off, on, left, right = (nodes[c].to_numpy(copy=True) for c in ("off", "on", "left", "right"))
    says, ends = on > off, np.cumsum(sizes)
    for end, size in zip(ends[::-1], sizes[::-1], strict=True):
        inner = np.arange(end - size, end)
        inner = inner[left[inner] >= 0]
        a, b = left[inner], right[inner]
        back = inner[(left[a] < 0) & (left[b] < 0) & (says[a] == says[b])]
        left[back] = right[back] = -1
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for end, size in zip(ends, sizes, strict=True):
        inner = np.arange(end - size, end)
        inner = inner[kept[inner] & (left[inner] >= 0)]
        kept[left[inner]] = kept[right[inner]] = True
    number = np.cumsum(kept) - 1
    leaf = left < 0
    flat, starts = np.concatenate([*cuts, [0.0]]), np.cumsum([0, *[len(c) for c in cuts]])
    feature = np.where(leaf, -1, nodes["feature"])
    threshold = np.where(leaf, np.nan, flat[np.where(leaf, 0, starts[feature] + nodes["bin"])])
    with np.errstate(divide="ignore", invalid="ignore"):
        value = on / (off + on)
    table = pd.DataFrame({
        "tree": tree, "node": number, "feature": feature, "threshold": pd.array(threshold, dtype="Float64"), "left": np.where(leaf, -1, number[left]), "right": np.where(leaf, -1, number[right]),
        "value": pd.array(value, dtype="Float64"), "off_rows": off, "on_rows": on, "impurity": _gini(off, on), "gain": np.where(leaf, -1.0, nodes["gain"]),
    })
    table.loc[leaf, "threshold"] = pd.NA
    table.loc[off + on == 0, "value"] = pd.NA
    return table[kept]


def _stored_nodes(df: DataFrame, trees: int, depth: int, seed: int, memory: int) -> tuple[str, int]:
    """Grow a forest on rows (x, target); the URI of its node table, and how many features there are."""
    spark = df.sparkSession

    def by_feature(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = np.stack(batch["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"feature": range(points.shape[1]), "numbers": [points[:, i].tobytes() for i in range(points.shape[1])]})

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(group["numbers"]))
        values = values[~np.isnan(values)]
        return pd.DataFrame({"feature": group["feature"].iloc[:1], "cuts": [cut_points(values, min(BINS, max(2, len(values))))]})

    found = df.select("x").mapInPandas(by_feature, "feature int, numbers binary").groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()
    if not found:
        raise ValueError("a forest needs rows to grow on")
    cuts = [np.array(r.cuts, float) for r in sorted(found, key=lambda r: r.feature)]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = np.stack(batch["x"].to_numpy()).astype(float)
                codes = [np.searchsorted(c, points[:, i]) for i, c in enumerate(cuts)]
                rows = np.stack([*codes, batch["target"].to_numpy() == 1], axis=1).astype(np.uint8)
                yield pd.DataFrame({"rows": [rows.tobytes()]})

    blocks, nodes, width = scratch_path(spark, "forest-rows"), scratch_path(spark, "forest"), len(cuts) + 1
    df.select("x", "target").mapInPandas(binned, "rows binary").write.parquet(blocks)
    at = root_uri(spark, blocks)

    def trees_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = None
        for batch in batches:
            if rows is None:
                rows = np.frombuffer(b"".join(cell for f in part_files(at) for cell in read_part(f, ["rows"])["rows"].to_pylist()), dtype=f"S{width}")
                rows = np.frombuffer(np.sort(rows).tobytes(), np.uint8).reshape(-1, width)
            for tree in batch["id"]:
                random = np.random.default_rng([seed, tree])
                yield grow(rows[:, :-1], rows[:, -1] == 1, random.poisson(1.0, len(rows)), cuts, tree, random, depth, memory)

    spark.range(0, trees, 1, min(trees, n_tasks(spark))).mapInPandas(trees_of, NODES).write.parquet(nodes)
    return root_uri(spark, nodes), len(cuts)


class _ForestParams(Params):
    cacheNodeIds = Param(Params._dummy(), "cacheNodeIds", "rows keep their nodes while trees grow; always so", TypeConverters.toBoolean)
    maxMemoryInMB = Param(Params._dummy(), "maxMemoryInMB", "counts of the nodes that are split in one pass", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below a root", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of bags and draws", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(cacheNodeIds=True, maxMemoryInMB=256, numTrees=20, maxDepth=5, seed=42)


class RandomForest(Estimator, _ForestParams):
    """Trees on bags of rows (Poisson of mean 1), from the columns ``features`` and ``target`` (1 is on)."""

    @keyword_only
    def __init__(self, *, numTrees: int = 20, maxDepth: int = 5, seed: int = 42, maxMemoryInMB: int = 256) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RandomForestModel:
        rows = df.select(vector_to_array("features").alias("x"), "target")
        number = {p: self.getOrDefault(p) for p in ("numTrees", "maxDepth", "seed", "maxMemoryInMB")}
        uri, n_features = _stored_nodes(rows, number["numTrees"], number["maxDepth"], number["seed"], number["maxMemoryInMB"])
        return self._copyValues(RandomForestModel(uri, n_features))


class RandomForestModel(Model, _ForestParams):
    """A stored forest: adds ``probability`` (off, on), the mean of the trees' leaves, and ``prediction``."""

    def __init__(self, uri: str, n_features: int) -> None:
        super().__init__()
        self.uri, self.numFeatures = uri, n_features

    @property
    def nodes(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.uri)

    @property
    def featureImportances(self) -> DenseVector:
        """Gains weighted by rows, shares of their sum in each tree, as shares of all trees; counted where the nodes lie."""
        gained = self.nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * (F.col("off_rows") + F.col("on_rows"))).alias("gained"))
        whole = gained.groupBy("tree").agg(F.sum("gained").alias("whole"))
        rows = gained.join(whole, "tree").groupBy("feature").agg(F.sum(F.try_divide("gained", "whole")).alias("share")).collect()
        total = np.zeros(self.numFeatures)
        for r in rows:
            total[r.feature] = r.share or 0.0
        return DenseVector(total / (total.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        uri = self.uri

        @F.pandas_udf("off double, on double")
        def votes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            parts = part_files(uri)
            for batch in batches:
                points = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))
                found = np.zeros((2, len(batch)))
                for part in parts if len(batch) else ():
                    for tree in trees_in(part):
                        found += tree_votes(tree, points)
                yield pd.DataFrame({"off": found[0], "on": found[1]})

        all_votes = F.col("_votes.off") + F.col("_votes.on")
        shares = [F.coalesce(F.try_divide(f"_votes.{side}", all_votes), F.lit(0.0)) for side in ("off", "on")]
        return df.withColumn("_votes", votes(vector_to_array("features"))).withColumns({
            "probability": array_to_vector(F.array(*shares)), "prediction": (F.col("_votes.on") > F.col("_votes.off")).cast("double"),
        }).drop("_votes")


def trees_in(part: str) -> Iterator[dict[str, np.ndarray]]:
    """The trees of a stored file, one at a time; a tree is in one file, its nodes in order."""
    names = ["tree", "feature", "threshold", "left", "right", "off_rows", "on_rows"]
    table = read_part(part, names)
    columns = {name: table[name].to_numpy() for name in names}
    starts = np.flatnonzero(np.diff(columns["tree"], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(columns["tree"])], strict=True):
        yield {name: c[a:b] for name, c in columns.items()}


def tree_votes(tree: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The shares of off and of on rows at the leaf of each point; none where the tree's bag was empty."""
    at, waiting = np.zeros(len(points), np.int64), np.arange(len(points))
    while len(waiting := waiting[tree["left"][at[waiting]] >= 0]):
        here = at[waiting]
        below = points[waiting, tree["feature"][here]] <= tree["threshold"][here]
        at[waiting] = np.where(below, tree["left"][here], tree["right"][here])
    off, on = tree["off_rows"][at], tree["on_rows"][at]
    n = np.where(off + on > 0, off + on, 1.0)
    return np.stack([off / n, on / n])


def switch_gains(tree: dict[str, np.ndarray], own: np.ndarray, base: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """What the tree's share of on gains where features switch, one by one in the order of their ranks, from ``base`` to ``own``: rows by ranks.

    A leaf is reached between two switches: after the last feature that only ``own`` leads there, until the first that only ``base`` does. So a tree
    costs the leaves that are passed on the way, not its score at every step.
    """
    n, d = own.shape
    own, base, ranks = (x.ravel() for x in (own, base, ranks))
    row, node = np.arange(n), np.zeros(n, np.int64)
    since, until = np.full(n, -1, ranks.dtype), np.full(n, d, ranks.dtype)
    places, changes = [], []
    n_rows = tree["off_rows"] + tree["on_rows"]
    values = tree["on_rows"] / np.where(n_rows > 0, n_rows, 1.0)
    while len(row):
        leaf = tree["left"][node] < 0
        ends = np.flatnonzero(leaf)
        value = values[node[ends]]
        for at, sign in ((since[ends], 1.0), (until[ends], -1.0)):
            kept = np.flatnonzero((at >= 0) & (at < d) & (value != 0))
            places.append(row[ends[kept]] * d + at[kept])
            changes.append(sign * value[kept])
        inner = np.flatnonzero(~leaf)
        row, node, since, until = row[inner], node[inner], since[inner], until[inner]
        threshold, cell = tree["threshold"][node], row * d + tree["feature"][node]
        mine, theirs, rank = own.take(cell) <= threshold, base.take(cell) <= threshold, ranks.take(cell)
        after, before = np.maximum(since, rank), np.minimum(until, rank)
        parts = []
        for side, mine_there, theirs_there in (("left", mine, theirs), ("right", ~mine, ~theirs)):
            first, last = np.where(theirs_there, since, after), np.where(mine_there, until, before)
            go = np.flatnonzero((mine_there | theirs_there) & (first < last))
            parts.append((row[go], tree[side][node[go]], first[go], last[go]))
        row, node, since, until = (np.concatenate(c) for c in zip(*parts, strict=True))
    return np.bincount(np.concatenate(places), np.concatenate(changes), n * d).reshape(n, d)


def switched(model: RandomForestModel, steps: DataFrame, run: str) -> DataFrame:
    """Rows (run, values): for neighbouring rows (run, own, base, draws) of one run, the sum of what the forest's score gains as each feature switches.

    Features switch in the order of their draws.
    """
    uri = model.uri

    def gained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SWITCHED):
                rows = batch.iloc[start : start + SWITCHED]
                own, base, draws = (np.stack(rows[c].to_numpy()) for c in ("own", "base", "draws"))
                ranks = draws.argsort(axis=1, kind="stable").argsort(axis=1)
                total, trees = 0.0, 0
                for part in part_files(uri):
                    for tree in trees_in(part):
                        trees += tree["off_rows"][0] + tree["on_rows"][0] > 0
                        total = total + switch_gains(tree, own, base, ranks)
                values = np.take_along_axis(total, ranks, axis=1) / max(trees, 1)
                first = np.flatnonzero(rows[run].ne(rows[run].shift()).to_numpy())
                yield pd.DataFrame({run: rows[run].to_numpy()[first], "values": list(np.add.reduceat(values, first, axis=0))})

    kind = dict(steps.dtypes)[run]
    return steps.select(run, "own", "base", "draws").mapInPandas(gained, f"`{run}` {kind}, values array<double>")
