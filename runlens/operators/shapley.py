"""Exact Shapley values of tree ensembles, from their node tables.

For a run x and a background run z, a leaf is reached by a mixture of both exactly if every feature on its path comes from one that
meets the path's bounds. So features fall into those that only x meets, those that only z meets, and those that both do; if one is met by
neither, the leaf never counts. The leaf's share of each feature then has a closed form in the two numbers of features. Values are sums over leaves and
means over the background: nothing is sampled, and no set of features is enumerated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.random_forest import part_files, read_part
from runlens.session import scratch_path, stored
from runlens.sources.files import n_tasks, root_uri

BACKGROUND = 100  # runs that stand for an absent feature's values
BLOCK = 1 << 16  # runs that go through a part of the leaves at once
NEIGHBOURS, NEW_BOUNDS = 3, 5  # leaves that are worked out together, and the bounds they may add to the first one's
FIRST_BOUNDS = 9  # bounds by which sets are told off in groups
LEAF_SCHEMA = "tree int, value double, features array<int>, low array<double>, high array<double>"
_FACTORIAL = np.array([float(math.factorial(i)) for i in range(171)])


def forest_nodes(model: PipelineModel) -> DataFrame:
    """The nodes of a fitted random forest: tree, node, feature, threshold, left, right (-1 at leaves), value, the share of class 1,
    off_rows and on_rows, impurity and gain. A tree whose bag was empty has no value, and no vote."""
    return model.stages[-1].nodes


def forest_leaves(nodes: DataFrame) -> DataFrame:
    """A row per leaf: its value, and for each feature on its path the bounds low < x <= high. A tree is one group of nodes."""

    def paths(table: pd.DataFrame) -> pd.DataFrame:
        known = {r.node: r for r in table.itertuples()}
        children = {c for r in known.values() for c in (r.left, r.right)}
        out, waiting = [], [(next(i for i in known if i not in children), {})]
        while waiting:
            at, bounds = waiting.pop()
            node = known[at]
            if node.left < 0:
                names = sorted(bounds)
                out.append((node.tree, node.value, names, [bounds[f][0] for f in names], [bounds[f][1] for f in names]))
                continue
            low, high = bounds.get(node.feature, (-math.inf, math.inf))
            waiting.append((node.left, bounds | {node.feature: (low, min(high, node.threshold))}))
            waiting.append((node.right, bounds | {node.feature: (max(low, node.threshold), high)}))
        return pd.DataFrame(out, columns=["tree", "value", "features", "low", "high"])

    wanted = nodes.select("tree", "node", "feature", "threshold", "left", "right", "value")
    return wanted.repartition(n_tasks(nodes.sparkSession), "tree").groupBy("tree").applyInPandas(paths, LEAF_SCHEMA)  # few bytes, much work


def _patterns(met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of a table of bits: packed in words, as they are, the row's number among them, and how often each is there."""
    n, width = met.shape
    words = -(-width // 64)
    packed = np.zeros((n, words * 8), np.uint8)
    packed[:, : -(-width // 8)] = np.packbits(met, axis=1, bitorder="little")
    packed = packed.view(np.uint64)
    if words == 1:
        _, first, place, times = np.unique(packed[:, 0], return_index=True, return_inverse=True, return_counts=True)
    else:
        _, first, place, times = np.unique(packed, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return packed[first], met[first], place.ravel(), times


def _coded(own: np.ndarray, base: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values as numbers of bounds below them, a row per feature; and each bound pair as its least number and how far it goes (-1: nothing lies between).

    Then ``low < x <= high`` is one unsigned comparison of bytes.
    """
    codes = [np.zeros((len(rows[0]), len(rows)), np.uint32) for rows in (own, base)]
    least, span = np.zeros(len(features), np.int64), np.zeros(len(features), np.int64)
    order = np.argsort(features, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(features[order])) + 1) if len(order) else ():
        f = features[part[0]]
        bounds = np.unique(np.concatenate([low[part], high[part]]))
        bounds = bounds[np.isfinite(bounds)]
        for coded, rows in zip(codes, (own, base), strict=True):
            coded[f] = np.searchsorted(bounds, rows[:, f])
        least[part] = np.searchsorted(bounds, low[part], side="right")
        span[part] = np.maximum(np.searchsorted(bounds, high[part]) - least[part], -1)
    most = max(int(c.max(initial=0)) for c in codes)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if max(most, int(least.max(initial=0))) <= np.iinfo(k).max)
    return codes[0].astype(kind), codes[1].astype(kind), least.astype(kind), span


def _classes(codes: Sequence[np.ndarray], least: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sets of bounds that rows miss (bounds by sets), and the place of each row's set among them.

    Sets are told apart some bounds at a time, by a table of the sets so far times those bounds, so nothing is sorted.
    """
    n, d, done = len(codes[0]), len(codes), 0
    sets, place = np.zeros((0, 1), bool), np.zeros(n, np.intp)
    bits, miss, gap = np.empty(n, np.uint8), np.empty(n, bool), np.empty(n, codes[0].dtype)
    while done < d:
        k = min(d - done, 16, max(1, 21 - sets.shape[1].bit_length()))
        for start in range(done, done + k, 8):
            chunk = range(start, min(start + 8, done + k))
            bits[:] = 0
            for j in chunk:
                np.subtract(codes[j], least[j], out=gap)
                np.greater(gap, span[j], out=miss)
                np.add(bits, bits, out=bits)
                np.add(bits, miss.view(np.uint8), out=bits)
            place <<= len(chunk)
            place += bits
        seen = np.zeros(sets.shape[1] << k, bool)
        seen[place] = True
        present = np.flatnonzero(seen)
        number = np.empty(len(seen), np.intp)
        number[present] = np.arange(len(present))
        place = number[place]
        sets = np.concatenate([sets[:, present >> k], (present >> np.arange(k - 1, -1, -1)[:, None] & 1).astype(bool)])
        done += k
    return sets, place


def _weights(most: int) -> tuple[np.ndarray, np.ndarray]:
    """By the numbers of features that only x and only z meets: what a leaf's value counts for one of the first, and against one of the others."""
    x, z = np.ogrid[: most + 1, : most + 1]
    ways = 1.0 / _FACTORIAL[np.minimum(x + z, 170)]
    return ways * _FACTORIAL[np.maximum(x - 1, 0)] * _FACTORIAL[z], ways * _FACTORIAL[x] * _FACTORIAL[np.maximum(z - 1, 0)]


def _bundles(keys: list[list[tuple]]) -> Iterator[tuple[list[int], dict[tuple, int]]]:
    """Neighbours among the leaves that add few bounds to those of the first, and the bounds of all of them, numbered."""
    i = 0
    while i < len(keys):
        known = {key: n for n, key in enumerate(keys[i])}
        most, own, shared = len(known) + NEW_BOUNDS, [i], set(known)
        while (i := i + 1) < len(keys) and len(own) < NEIGHBOURS:
            new = [key for key in keys[i] if key not in known]
            if len(known) + len(new) > most or len(known) + len(new) - len(shared & set(keys[i])) > 64:  # the bounds that not all share fit into a word
                break
            shared &= set(keys[i])
            known |= {key: len(known) + n for n, key in enumerate(new)}
            own.append(i)
        yield own, known


def _words(miss: np.ndarray) -> np.ndarray:
    """Columns of at most 64 bits as numbers; the first bit is the highest."""
    found = np.zeros(miss.shape[1], np.uint64)
    for row in miss:
        found += found
        found += row
    return found


def _counted(miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns, and how often each is there."""
    if len(miss) <= 64:
        _, first, times = np.unique(_words(miss), return_index=True, return_counts=True)
        return miss[:, first], times
    _, rows, _, times = _patterns(miss.T)
    return rows.T, times


def _meeting(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of columns (of a, of b) that have no bit in common."""
    x, z = pairs
    for start in range(0, len(a), 64):
        met = (_words(a[start : start + 64])[x] & _words(b[start : start + 64])[z]) == 0
        x, z = x[met], z[met]
    return x, z


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of columns without a common bit. The columns of ``a`` are in order, so those with the same first bits are told off together."""
    n = min(len(a), FIRST_BOUNDS)
    heads = _words(a[:n])
    starts = np.flatnonzero(np.diff(heads, prepend=heads[0] + np.uint64(1)))
    sizes = np.diff(starts, append=len(heads))
    group, z = np.nonzero((heads[starts][:, None] & _words(b[:n])) == 0)
    times = sizes[group]
    x = np.arange(times.sum()) + np.repeat(starts[group] - np.cumsum(times) + times, times)
    return _meeting(a[n:], b[n:], (x, np.repeat(z, times)))


def contributions(own: np.ndarray, base: np.ndarray, leaves: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, float]:
    """Values (features by rows of ``own``), scores, and the mean score of ``base``, summed over the leaves.

    ``leaves`` are flat: values, where each leaf's bounds end (from 0 on), and the bounds' features, low and high. Rows that miss the same bounds
    share their values, so a leaf costs its distinct sets, and of their pairs those that reach it. Neighbours of one tree share most bounds: a few of
    them are worked out together, and rows look up their sum, once per feature.
    """
    value, ends, features, low, high = leaves
    out, score, mean = np.zeros(own.shape[::-1]), np.zeros(len(own)), 0.0
    mine, theirs, least, span = _coded(own, base, features, low, high)
    widths, reachable = np.diff(ends), np.ones(len(value), bool)
    reachable[np.repeat(np.arange(len(value)), widths)[span < 0]] = False
    score += value[widths == 0].sum()
    mean += value[widths == 0].sum()
    wanted = np.flatnonzero(reachable & (widths > 0) & (value != 0))  # all that a leaf adds is a multiple of its value
    triples = list(zip(features.tolist(), least.tolist(), span.tolist(), strict=True))
    gains_of, losses_of = _weights(int(widths.max(initial=0)))
    taken = np.empty(len(own))
    for chosen, known in _bundles([triples[ends[i] : ends[i + 1]] for i in wanted]):
        held = [{known[t] for t in triples[ends[i] : ends[i + 1]]} for i in wanted[chosen]]
        shared = set.intersection(*held)
        order = sorted(range(len(known)), key=lambda n: (n not in shared, n))  # what all leaves have comes first
        f, lo, wide = (np.array(c)[order] for c in zip(*known, strict=True))
        lo = lo.astype(least.dtype)
        a, place = _classes([mine[k] for k in f], lo, wide)
        b, times = _counted((theirs[f] - lo[:, None]) > wide[:, None])
        n = len(shared)
        x, z = _joined(a[:n], b[:n])
        used, column = np.unique(f, return_inverse=True)
        sums, reached = np.zeros((len(used), a.shape[1])), np.zeros(a.shape[1])
        # what holds for all leaves of the pairs: the numbers of bounds missed, and what they miss of the other bounds
        n_a, n_b = np.count_nonzero(a[:n], axis=0), np.count_nonzero(b[:n], axis=0)
        rest_a, rest_b = _words(a[n:]), _words(b[n:])
        sizes, of_a, of_b = n_b[z] * len(gains_of) + n_a[x], rest_a[x], rest_b[z]
        both, ways = of_a & of_b, times[z] / len(base)
        gained, lost = np.zeros(len(x)), np.zeros(a.shape[1])
        for i, bounds in zip(wanted[chosen], held, strict=True):
            own = [k for k in range(n, len(order)) if order[k] in bounds]  # besides the shared ones
            mask = np.uint64(sum(1 << (len(order) - 1 - k) for k in own))
            reached[(n_a == 0) & (rest_a & mask == 0)] += value[i]
            mean += value[i] * times[(n_b == 0) & (rest_b & mask == 0)].sum() / len(base)
            met = np.flatnonzero(both & mask == 0)
            size = sizes[met] + len(gains_of) * np.bitwise_count(of_b[met] & mask).astype(np.intp) + np.bitwise_count(of_a[met] & mask)
            weight, row = ways[met] * value[i], x[met]  # a bound is met by one of the two, so what z misses only x meets
            gain, loss = weight * gains_of.ravel()[size], np.bincount(row, weight * losses_of.ravel()[size], a.shape[1])
            gained[met] += gain
            lost += loss
            for k in own:
                theirs_alone = b[k][z[met]]
                sums[column[k]] += np.bincount(row[theirs_alone], gain[theirs_alone], a.shape[1]) - a[k] * loss
        reaching = np.flatnonzero(np.bincount(x, minlength=a.shape[1]))
        at = np.empty(a.shape[1], np.intp)
        at[reaching] = np.arange(len(reaching))
        dense = np.zeros((len(reaching), len(times)))
        dense.ravel()[at[x] * len(times) + z] = gained
        sums[column[:n, None], reaching] += (dense @ b[:n].T.astype(float)).T
        for k in range(n):
            sums[column[k]] -= a[k] * lost
        score += reached[place]
        for k, shares in zip(used, sums, strict=True):
            np.take(shares, place, out=taken, mode="clip")
            out[k] += taken
    return out, score, mean


def _flat(part: str) -> tuple[np.ndarray, ...]:
    table = read_part(part, ["value", "features", "low", "high"]).combine_chunks()
    if not len(table):
        return np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    lists = {name: table[name].combine_chunks() for name in ("features", "low", "high")}
    return table["value"].to_numpy(), lists["features"].offsets.to_numpy(), *[lists[name].flatten().to_numpy() for name in lists]


def explain(vectors: DataFrame, run: str, leaves: DataFrame, background: DataFrame, trees: int) -> DataFrame:
    """Rows (run, score, base, values): the ensemble's mean score of each run, of the background, and a Shapley value per feature.

    ``vectors`` and ``background`` hold ``own``, the features as an array. A run's values add up to its score minus the base. Runs are stored in
    blocks and leaves in parts; a task takes a block through a part, and the sums of a block's parts are added up. So leaves and runs do not pass
    the driver, and a task holds one block and one part. The background is a few runs.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[run]
    schema = f"`{run}` {kind}, score double, base double, values array<double>"
    base = np.array([r.own for r in background.select("own").collect()], float)
    if not len(base):
        return spark.createDataFrame([], schema)
    blocks, parts, sums = (scratch_path(spark, f"shapley-{name}") for name in ("runs", "leaves", "sums"))
    vectors.select(F.col(run).alias("run"), "own").repartition(max(1, -(-vectors.count() // BLOCK))).write.parquet(blocks)
    by_tree = leaves.repartitionByRange(2 * n_tasks(spark), "tree")  # a tree's leaves stay together, and neighbours in their order
    by_tree.select("value", "features", "low", "high").write.parquet(parts)
    block_files, leaf_files = (part_files(root_uri(spark, path)) for path in (blocks, parts))
    tasks = [(i, block, part) for i, block in enumerate(block_files) for part in leaf_files]
    shared = spark.sparkContext.broadcast((tasks, block_files, base))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tasks, _, base = shared.value
        for batch in batches:
            for at in batch["id"]:
                i, block, part = tasks[at]
                own = _own(block)
                if len(own):
                    values, scores, mean = contributions(own, base, _flat(part))
                    yield pd.DataFrame({"block": [i], "scores": [scores.tobytes()], "base": [mean], "values": [values.tobytes()]})

    spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(summed, "block int, scores binary, base double, values binary").write.partitionBy("block").parquet(sums)
    at_sums = root_uri(spark, sums)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, block_files, _ = shared.value
        for batch in batches:
            for i in batch["id"]:
                runs = read_part(block_files[i], ["run"])["run"].to_pandas()
                if not len(runs):
                    continue
                values, scores, mean = 0.0, 0.0, 0.0
                for part in part_files(f"{at_sums}block={i}/"):
                    for row in read_part(part, ["scores", "base", "values"]).to_pylist():
                        values = values + np.frombuffer(row["values"]).reshape(-1, len(runs))
                        scores, mean = scores + np.frombuffer(row["scores"]), mean + row["base"]
                values = (values / trees).T
                for a in range(0, len(runs), 4096):
                    own = slice(a, a + 4096)
                    yield pd.DataFrame({run: runs[own], "score": scores[own] / trees, "base": mean / trees, "values": list(values[own])})

    return spark.range(0, len(block_files), 1, len(block_files)).mapInPandas(added, schema)


def _own(block: str) -> np.ndarray:
    cells = read_part(block, ["own"])["own"].combine_chunks()
    return cells.flatten().to_numpy().reshape(len(cells), -1) if len(cells) else np.zeros((0, 0))


def forest_shapley(model: PipelineModel, df: DataFrame, run: str, background: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``explain`` for a fitted random forest pipeline; the background is ``BACKGROUND`` runs of ``df`` in the order of a hash, or the runs given."""
    vectors = model.stages[0].transform(df).select(run, vector_to_array("features").alias("own"))
    if background is None:
        chosen = vectors.orderBy(F.xxhash64(F.col(run), F.lit(seed)), run).limit(BACKGROUND)
    else:
        chosen = model.stages[0].transform(background).select(vector_to_array("features").alias("own"))
    leaves = stored(forest_leaves(forest_nodes(model)).where(F.col("value").isNotNull()), "leaves")
    return explain(vectors, run, leaves, chosen, max(1, leaves.select("tree").distinct().count()))


def values_by_feature(explained: DataFrame, run: str, features: Sequence[str]) -> DataFrame:
    """Rows (run, feature, value)."""
    names = F.array(*[F.lit(f) for f in features])
    return explained.select(run, F.inline(F.arrays_zip(names.alias("feature"), F.col("values").alias("value"))))


def importance(explained: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute value per feature."""
    means = explained.agg(*[F.avg(F.abs(F.col("values")[i])).alias(f"m{i}") for i in range(len(features))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("importance")) for i, f in enumerate(features)])
    return means.select(F.inline(rows)).where(F.col("importance").isNotNull())


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """Per tree: whether the rows of every split are those of its children, and its impurity and gain are what these rows give.

    A root that cannot be split, as its rows are of one class, has no impurity worked out (-1).
    """
    def gini(off, on):
        return 1 - F.try_divide(off * off + on * on, (off + on) * (off + on))

    side = {s: nodes.select("tree", F.col("node").alias(s), F.col("off_rows").alias(f"{s}_off"), F.col("on_rows").alias(f"{s}_on")) for s in ("left", "right")}
    joined = nodes.join(side["left"], ["tree", "left"], "left").join(side["right"], ["tree", "right"], "left")
    inner, n = F.col("left") >= 0, F.col("off_rows") + F.col("on_rows")
    parts = {s: F.col(f"{s}_off") + F.col(f"{s}_on") for s in side}
    after = sum((F.try_divide(parts[s], n) * gini(F.col(f"{s}_off"), F.col(f"{s}_on")) for s in side), F.lit(0.0))
    near = F.abs(F.col("off_rows") - F.col("left_off") - F.col("right_off")) + F.abs(F.col("on_rows") - F.col("left_on") - F.col("right_on"))
    return joined.groupBy("tree").agg(
        F.every(~inner | (near < 1e-9)).alias("rows_add_up"),
        F.every((n == 0) | (F.col("impurity") < 0) | (F.abs(F.col("impurity") - gini(F.col("off_rows"), F.col("on_rows"))) < 1e-9)).alias("impurity_fits"),
        F.every(~inner | ((F.col("gain") > 0) & (F.abs(F.col("gain") - (F.col("impurity") - after)) < 1e-9))).alias("gain_fits"),
    )

