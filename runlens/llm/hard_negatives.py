"""Hard negatives by the threshold algorithm: sorted lists per dimension, read from the end that the anchor's sign names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.vectors import in_tiles, matrix, whole_vector
from runlens.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # percent of the positive's score between which a negative's lies
ROWS, ANCHORS = 4096, 16384  # rows of a block and anchors of a range
FIRST_DEPTH = 16
EXACT = float(1 << 53)


class Lists:
    """Rows of a block with, for every dimension, their order by component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        self.most = np.abs(self.values).max(initial=0.0)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products; doubles hold them exactly unless they are huge."""
        if self.most * np.abs(anchor).max(initial=0.0) * len(anchor) < EXACT:
            return (self.values[rows] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor.tolist()]
        return np.array([sum(a * int(x) for a, x in zip(whole, row, strict=True)) for row in self.values[rows].tolist()], object)

    def deepening(self, anchor: np.ndarray):
        """Rows seen anew and their scores, depth by depth, with a bound on the scores of all rows not yet seen; at the end None.

        Sorted access goes down the list of every dimension at once: from the largest component where the anchor's is
        positive, from the least where it is negative. Rows not seen lie below the last component read in every list, so none
        scores more than the sum of anchor times those components. A dimension in which the anchor is zero has no list.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        depth, read = FIRST_DEPTH, 0
        if not len(up) + len(down):
            rows = np.arange(n)
            yield rows, self.scores(rows, anchor), None
            return
        while True:
            depth = min(depth, n)
            touched = np.zeros(n, bool)
            touched[self.order[n - depth : n - read, up]] = True
            touched[self.order[read:depth, down]] = True
            rows = np.flatnonzero(touched & ~seen)
            seen |= touched
            found = self.scores(rows, anchor)
            if depth == n:
                yield rows, found, None
                return
            bound = float(self.sorted[n - depth, up] @ anchor[up] + self.sorted[depth - 1, down] @ anchor[down])
            yield rows, found, bound + abs(bound) * 1e-12  # the bound may be rounded where scores are huge
            depth, read = depth * 2, depth


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def top_positives(lists: Lists, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best other rows of the anchor's label in the block."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, found, bound in lists.deepening(anchor):
        fit = (lists.labels[rows] == label) & (lists.ids[rows] != anchor_id)
        ids, scores = np.append(ids, lists.ids[rows[fit]]), np.append(scores, found[fit])
        top = best(ids, scores, k)
        ids, scores = ids[top], scores[top]
        if bound is not None and len(ids) == k and bound < scores[-1]:
            break
    return ids, scores


def window_negatives(lists: Lists, label: int, anchor: np.ndarray, positives: list[int], k: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(window, id, score) of the k best rows of other labels in each window: low * positive <= 100 * score <= high * positive.

    The lists are read until the bound is strictly below the kth score of every window, or below all that the window admits.
    """
    tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in positives]
    for rows, found, bound in lists.deepening(anchor):
        other = lists.labels[rows] != label
        own, scored = lists.ids[rows[other]], found[other]
        open_ = False
        for w, positive in enumerate(positives):
            fit = (scored * 100 >= low * positive) & (scored * 100 <= high * positive)
            ids, scores = np.append(tops[w][0], own[fit]), np.append(tops[w][1], scored[fit])
            top = best(ids, scores, k)
            tops[w] = ids[top], scores[top]
            if bound is not None:
                kth = tops[w][1][-1] if len(top) == k else None
                open_ |= not (bound * 100 < low * positive or (kth is not None and bound < kth)) and low * positive <= high * positive
        if not open_:
            break
    return [(w, i, s) for w, (ids, scores) in enumerate(tops) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``q``, the components times ``scale`` rounded down, of the rows that take part; one row an id."""
    fit = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole_vector(F.col("embedding")))
    rows = fit.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("q"),
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def mine(
    vectors: DataFrame, anchors: DataFrame, *, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, block: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``anchors`` (vec_id) among ``vectors`` (vec_id, label, embedding).

    Components are multiplied by ``scale`` as doubles and rounded down; a score is the integer inner product of those of a row and of
    the anchor. Scores rank from high to low, ties by smaller vec_id. An anchor's positives are its first ``positives`` other
    rows of its label; for each, the first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive are returned.

    Every anchor meets every row, in tiles of a block of rows and a range of anchors. In a tile the threshold algorithm finds the best
    rows: sorted access per dimension, integer scores by random access, and a stop once the threshold is strictly below the kth score
    of every window. At most ``positives`` or ``negatives`` rows per tile and window are merged.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor do anchors that name
    none. Of several rows with one id the least by label and vector counts; repeated rows thus are one. Shorter
    vectors are filled up with zeros. An anchor without positives, or a window without rows, gives no rows; so does an empty
    table. A score beyond 64 bits fails. Other columns are left out.
    """
    rows = materialize(quantized(vectors, scale))
    width = rows.agg(F.max(F.size("q"))).first()[0] or 1
    wanted = rows.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    tiled, asked = in_tiles(rows, wanted, "vec_id", block, ANCHORS)

    def block_of(table: pa.Table) -> Lists:
        return Lists(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("q"), width))

    def first(own: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if own.num_rows and queries.num_rows:
            lists = block_of(own)
            for anchor_id, label, anchor in zip(queries.column("vec_id").to_pylist(), queries.column("label").to_pylist(), matrix(queries.column("q"), width), strict=True):
                ids, scores = top_positives(lists, anchor_id, label, anchor, positives)
                out["anchor_id"] += [anchor_id] * len(ids)
                out["positive_id"] += ids.tolist()
                out["positive_score"] += scores.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    def second(own: pa.Table, queries: pa.Table) -> pa.Table:
        out = {name: [] for name in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if own.num_rows and queries.num_rows:
            lists = block_of(own)
            columns = [queries.column(c).to_pylist() for c in ("vec_id", "label", "pairs")]
            for anchor_id, label, pairs, anchor in zip(*columns, matrix(queries.column("q"), width), strict=True):
                scores = [p["positive_score"] for p in pairs]
                for w, negative_id, score in window_negatives(lists, label, anchor, scores, negatives, low, high):
                    for column, value in zip(out.values(), (anchor_id, pairs[w]["positive_id"], scores[w], negative_id, score), strict=True):
                        column.append(value)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    def together(left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
        return left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(function, schema)

    found = together(tiled, asked, first, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = materialize(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"))
    paired = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"))
    tiled, asked = in_tiles(rows, wanted.join(paired, "vec_id"), "vec_id", block, ANCHORS)
    mined = together(tiled, asked, second, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
