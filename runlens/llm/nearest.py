"""Approximate nearest neighbours: p-stable hashing whose perturbed buckets are visited in the order of their estimated success."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.vectors import matrix, renewed, whole_vector
from runlens.llm.words import mixed
from runlens.session import materialize, scratch_path

TABLES = 4
RATIO = 2.0  # width of a bucket over the spread of projections
CELL = 512  # vectors that a bucket of the chosen number of functions holds about
FUNCTIONS = 12  # functions of a table at most
SUCCESS = 0.93  # estimated chance that a neighbour as far as the kth shares a visited bucket in some table
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20  # vectors, and their bytes, that the widths and distances are learnt from
TILE, ASKED = 32768, 16384  # vectors and queries that meet in a task
TOGETHER, BLOCK = 512, 4096  # queries and vectors scored at once
LEAST_MASS = 1e-4  # chance below which a perturbation of one function is left out
_TAIL = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])


class Hashes:
    """``tables`` times ``functions`` projections on Gaussian vectors, cut into buckets of one width.

    The largest inner product is the least distance once every vector gets one more component that makes all norms equal, and the
    queries a zero there.
    """

    def __init__(self, sample: np.ndarray, total: int, unit: float, norm: float, k: int, seed: int, tables: int, success: float):
        """``unit``: the largest component, ``norm``: the largest norm in that unit."""
        self.unit, self.norm, self.success, self.tables = unit, norm, success, tables
        functions = max(1, min(FUNCTIONS, round(math.log2(max(1.0, total / CELL)) / (2.05 - math.log2(RATIO)))))
        rng = np.random.default_rng(seed)
        self.lines = rng.normal(size=(sample.shape[1] + 1, tables * functions))
        known = self.lifted(sample)
        self.width = max(RATIO * float((known @ self.lines).std()), 1e-9 * norm)
        self.offsets = rng.uniform(0, self.width, tables * functions)
        self.sample = known[:, :-1]
        self.rank = min(len(sample) - 1, math.ceil(k * len(sample) / max(1, total)))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.unit
        return np.column_stack([scaled, np.sqrt(np.maximum(0.0, self.norm**2 - (scaled * scaled).sum(axis=1)))])

    def _cells(self, places: np.ndarray) -> np.ndarray:
        """64-bit numbers of buckets, from their coordinates (rows) in one table; the table's number is the last coordinate."""
        out = np.zeros(len(places), np.uint64)
        for column in places.T:
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        places = np.floor((self.lifted(vectors) @ self.lines + self.offsets) / self.width).reshape(len(vectors), self.tables, -1)
        return np.stack([self._cells(np.column_stack([places[:, t], np.full(len(vectors), t)])) for t in range(self.tables)], axis=1)

    def probes(self, queries: np.ndarray) -> list[list[np.ndarray]]:
        """Per query and table, the buckets to visit, likeliest first.

        The difference of a query and a neighbour at distance d projects to a Gaussian of deviation d; d is the distance of the kth
        neighbour as the sample shows it. The chance of a bucket is the product of its functions' chances. Buckets are
        visited until their chances add up to what each table owes to ``success``.
        """
        norms = np.sqrt(((queries / self.unit) ** 2).sum(axis=1))
        scaled = queries / self.unit * (self.norm / norms)[:, None]
        square = 2 * self.norm**2 - 2 * (scaled @ self.sample.T)
        far = np.sqrt(np.maximum(0.0, np.partition(square, self.rank, axis=1)[:, self.rank]))
        sigma = np.maximum(far / self.width, 1e-3)
        spots = ((np.column_stack([scaled, np.zeros(len(queries))]) @ self.lines + self.offsets) / self.width).reshape(len(queries), self.tables, -1)
        owed = 1 - (1 - self.success) ** (1 / self.tables)
        spare = (1 - owed) / 10  # chance that may be lost to pruning on the way
        out = []
        for spot, deviation in zip(spots, sigma.tolist(), strict=True):
            reach = math.ceil(4 * deviation)
            steps = np.arange(-reach, reach + 2)
            home = np.floor(spot)
            edge = _TAIL((steps - (spot - home)[..., None]) / deviation)
            chance, steps = np.diff(edge, axis=-1), steps[:-1]
            mine = []
            for table in range(self.tables):
                places, mass = np.zeros((1, 0)), np.ones(1)
                for f in range(spot.shape[1]):
                    likely = chance[table, f] >= min(LEAST_MASS, chance[table, f].max())
                    step, p = steps[likely], chance[table, f, likely]
                    product = (mass[:, None] * p).ravel()
                    order = np.argsort(-product, kind="stable")
                    order = order[: np.searchsorted(np.cumsum(product[order]), product.sum() - spare / spot.shape[1]) + 1]
                    places = np.column_stack([places[order // len(p)], home[table, f] + step[order % len(p)]])
                    mass = product[order]
                count = np.searchsorted(np.cumsum(mass), owed) + 1
                mine.append(self._cells(np.column_stack([places[:count], np.full(len(places[:count]), table)])))
            out.append(mine)
        return out


def taking_part(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and embedding of rows with an id and a finite vector other than zero; the least vector of an id."""
    fit = vectors.where(F.col(vec_id).isNotNull() & whole_vector(F.col(embedding)) & F.exists(embedding, lambda x: x != 0))
    rows = fit.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Each vector once, with its k + 1 least ids: no list of neighbours can name others of them."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _numbered(df: DataFrame, label: str) -> DataFrame:
    """A small table of counts, stored: Spark knows its size when it plans a join with it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _parts(count: Column, each: int) -> Column:
    return F.ceil(count / each).cast("int")


def _first_places(order: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Of places ordered by group, the first k of every group."""
    own = groups[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < k]


def best_in_tile(points: np.ndarray, cells: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, names: np.ndarray, asked: list[np.ndarray], k: int):
    """(query, vec_id, score) of the k best vectors in the cells that each query asks for.

    A matrix product finds whatever may be among the k + 1 best, with room for its rounding; those are scored one component after
    the other in double precision, the same way in every tile.
    """
    order = np.argsort(cells, kind="stable")
    points, cells, ids = points[order], cells[order], [ids[i] for i in order.tolist()]
    norms = np.sqrt((points * points).sum(axis=1)).max(initial=0.0)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    every, first = np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum(sizes) - sizes
    for begin in range(0, len(queries), TOGETHER):
        own, part = queries[begin : begin + TOGETHER], asked[begin : begin + TOGETHER]
        room = 8 * points.shape[1] * np.finfo(float).eps * norms * np.sqrt((own * own).sum(axis=1))
        kth = np.full((len(own), k + 1), -np.inf)
        visits = np.repeat(np.arange(len(part)), [len(x) for x in part])
        wanted = np.concatenate([np.zeros(0, np.int64), *part])
        by_cell = np.argsort(wanted, kind="stable")
        visits, wanted = visits[by_cell], wanted[by_cell]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]])) if len(wanted) else []
        for a, b in zip(starts, np.append(starts[1:], len(wanted)) if len(wanted) else [], strict=True):
            who = visits[a:b]
            low, high = np.searchsorted(cells, wanted[a], "left"), np.searchsorted(cells, wanted[a], "right")
            for at in range(low, high, BLOCK):
                near = own[who] @ points[at : min(at + BLOCK, high)].T
                both = np.concatenate([kth[who], near], axis=1)
                kth[who] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                row, column = np.nonzero(near >= (kth[who].min(axis=1) - room[who])[:, None])
                found.append((who[row], at + column, near[row, column]))
        if not found:
            continue
        q, p, near = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = near >= kth.min(axis=1)[q] - room[q]
        q, p = q[keep], p[keep]
        score = np.zeros(len(q))
        for d in range(points.shape[1]):
            score += own[q, d] * points[p, d]
        times = sizes[p]
        pick = np.repeat(first[p] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        q, score, near_id = np.repeat(q, times), np.repeat(score, times), every[pick]
        other = near_id != names[begin + q]
        q, score, near_id = q[other], score[other], near_id[other]
        top = _first_places(np.lexsort((near_id, -score, q)), q, k)
        yield names[begin + q[top]], near_id[top], score[top]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, *, vec_id: str = "vec_id", embedding: str = "embedding",
    tables: int = TABLES, success: float = SUCCESS, seed: int = 7, tile: int = TILE,
) -> DataFrame:
    """query_id, rank, vec_id and score: for each id in ``queries`` its ``k`` nearest vectors found, other than its own.

    Nearness is the largest inner product of the original vectors, in double precision; ties go to the smaller vec_id. A score is
    exact, a list may miss a neighbour: ``success`` is the estimated chance to visit the bucket of one as far as the kth.

    Each distinct vector is hashed into ``tables`` tables; a query visits its own and perturbed buckets, likeliest first, until their
    chances add up. Buckets are packed into tiles of about ``tile`` vectors. A bucket that holds more is split into parts that all its visitors
    meet, and a tile with many visitors is split by visitor: nothing is left out and no group is unbounded. Widths, the
    number of functions and the visitors' distances are learnt from ``SAMPLE`` vectors or ``SAMPLE_BYTES``; all vectors are indexed.

    Rows with a null id or vector, an empty vector, a zero vector, or a null or non-finite component take no part, as query or
    candidate. Of several rows with one id the least vector counts, so repeated rows are one. Equal vectors are looked at once. Shorter vectors
    are filled up with zeros. Queries get all candidates found if there are fewer than k; an empty table gives no rows.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = materialize(taking_part(vectors, vec_id, embedding))
    classes = materialize(distinct_vectors(rows, k))
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    total, width, unit = classes.agg(F.count("*"), F.max(F.size("embedding")), F.max(largest)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / unit) * (x.cast("double") / unit))
    norm = math.sqrt(classes.agg(F.max(square)).first()[0])
    drawn = classes.orderBy(F.xxhash64("embedding"), F.col("ids")[0]).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width))))
    hashes = Hashes(matrix(drawn.select("embedding").toArrow().column(0), width), total, unit, norm, k, seed, tables, success)
    wanted = rows.join(queries.select(F.col(vec_id).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")

    def place(batches):
        for batch in batches:
            cells = hashes.buckets(matrix(batch.column("embedding"), width))
            for table in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, table, np.int32)), pa.array(cells[:, table]), batch.column("ids"), batch.column("embedding")],
                    ["t", "cell", "ids", "embedding"],
                )

    def visit(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begin, TOGETHER)
                probes = hashes.probes(matrix(part.column("embedding"), width))
                for table in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id"), pa.array(np.full(part.num_rows, table, np.int32)), pa.array([p[table] for p in probes], pa.list_(pa.int64()))],
                        ["query_id", "t", "cells"],
                    )

    kind = dict(classes.dtypes)["embedding"]
    placed = classes.mapInArrow(place, f"t int, cell long, ids array<long>, embedding {kind}")
    occupied = _numbered(
        placed.groupBy("t", "cell").agg(_parts(F.count("*"), tile).alias("parts")), "cells"
    )
    groups = max(1, -(-total // tile))

    def group(part: Column) -> Column:
        return F.col("t") * groups + F.pmod(F.xxhash64("cell", part), F.lit(groups)).cast("int")

    asked = (
        wanted.mapInArrow(visit, "query_id long, t int, cells array<long>").select("query_id", "t", F.explode("cells").alias("cell"))
        .join(occupied, ["t", "cell"])
        .select("query_id", "t", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .groupBy("query_id", group(F.col("part")).alias("tile")).agg(F.collect_set("cell").alias("cells"))
    )
    asked = materialize(asked)
    shares = _numbered(asked.groupBy("tile").agg(_parts(F.count("*"), ASKED).alias("shares")), "tiles")
    visitors = (
        asked.join(shares, "tile").join(wanted.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
        .withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int"))
    )
    crowded = occupied.where(F.col("parts") > 1)
    dealt = (
        placed.join(crowded, ["t", "cell"], "left")
        .withColumn("tile", group(F.pmod(F.xxhash64(F.col("ids")[0]), F.coalesce("parts", F.lit(1))).cast("int")))
        .join(shares, "tile")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .select("tile", "share", "cell", "ids", "embedding")
    )

    def search(own: pa.Table, seekers: pa.Table) -> pa.Table:
        out = ([], [], [])
        if own.num_rows and seekers.num_rows:
            lists = [np.array(x, np.int64) for x in seekers.column("cells").to_pylist()]
            ids = [np.array(x, np.int64) for x in own.column("ids").to_pylist()]
            names, cells = seekers.column("query_id").to_numpy(), own.column("cell").to_numpy()
            for found in best_in_tile(matrix(own.column("embedding"), width), cells, ids, matrix(seekers.column("embedding"), width), names, lists, k):
                for column, values in zip(out, found, strict=True):
                    column.append(values)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for n, v, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    merged = dealt.groupBy("tile", "share").cogroup(renewed(visitors).groupBy("tile", "share")).applyInArrow(search, "query_id long, vec_id long, score double")
    once = merged.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
