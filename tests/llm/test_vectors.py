"""Hard negatives and nearest neighbours: against brute force, on odd rows, hot vectors, and in many small tiles."""

import numpy as np
import pandas as pd
import pytest

from runlens.llm import hard_negatives, nearest
from runlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, tile int, q string, ids string"


def frame(spark, vectors, labels, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i) if i is not None else None, None if v is None else [None if x is None else float(x) for x in v], lab, 1, "q", "x") for i, v, lab in zip(ids, vectors, labels, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_negatives(vectors, labels, ids, anchors):
    q = [[int(np.floor(256 * float(x))) for x in v] for v in vectors]
    out = []
    for a in anchors:
        at = ids.index(a)
        score = {i: sum(x * y for x, y in zip(q[at], v, strict=True)) for i, v in zip(ids, q, strict=True)}
        label = dict(zip(ids, labels, strict=True))
        ranked = sorted((i for i in ids if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if label[i] == labels[at]][:5]:
            fit = [i for i in ranked if label[i] != labels[at] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_in_small_tiles(spark, monkeypatch):
    """Many tiles, many ties and clusters, in which the threshold stops early."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = np.round(centres[rng.integers(0, 6, 300)] + rng.normal(scale=0.2, size=(300, 8)), 1)
    vectors[:60] = vectors[0]
    labels, ids = [int(x) for x in rng.integers(0, 4, 300)], list(range(300))
    df = frame(spark, vectors, labels)
    anchors = [i for i in ids if i % 10 == 0]
    out = hard_negatives.mine(df, df.where("vec_id % 10 = 0"), block=64)
    assert mined(out) == brute_negatives(vectors, labels, ids, anchors)


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    values = np.floor(256 * rng.normal(size=(4000, 3)))
    lists = hard_negatives.Lists(np.arange(4000), np.zeros(4000, np.int64), values)
    anchor = np.array([200.0, -100.0, 0.0])
    read = 0
    for rows, found, bound in lists.deepening(anchor):
        read += len(rows)
        assert (found == (values[rows] @ anchor).astype(np.int64)).all()
        unseen = np.setdiff1d(np.arange(4000), rows)
        if bound is not None and bound < np.sort(values @ anchor)[-5]:
            break
    assert read < 2000 and len(unseen)
    ids, scores = hard_negatives.top_positives(lists, -1, 0, anchor, 5)
    assert scores.tolist() == sorted((values @ anchor).astype(int).tolist(), reverse=True)[:5]


def test_huge_components_are_exact():
    values = np.array([[2.0**40, 3.0], [2.0**40, 4.0], [-(2.0**40), 1.0]])
    lists = hard_negatives.Lists(np.arange(3), np.zeros(3, np.int64), values)
    ids, scores = hard_negatives.top_positives(lists, -1, 0, np.array([2.0**20, 1.0]), 2)
    assert ids.tolist() == [1, 0] and list(scores) == [2**60 + 4, 2**60 + 3]


BAD = [(1000, None, 1), (1010, [1.0, None, 0.0], 1), (1020, [float("nan"), 0.0, 1.0], 1), (1030, [float("inf"), 0.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (1040, [], 1)]


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors, labels, ids = [list(map(float, v)) for v in rng.normal(size=(40, 3))], [int(x) for x in rng.integers(0, 2, 40)], list(range(40))
    bad = [*BAD, (1050, [1.0, 2.0, 3.0], None)]
    df = frame(spark, [*vectors, *vectors[:5], *[b[1] for b in bad]], [*labels, *labels[:5], *[b[2] for b in bad]], [*ids, *ids[:5], *[b[0] for b in bad]])
    out = hard_negatives.mine(df, df.where("vec_id % 10 = 0 or vec_id is null"))
    assert mined(out) == brute_negatives(vectors, labels, ids, [0, 10, 20, 30])
    assert hard_negatives.mine(df.where("false"), df).collect() == []
    assert hard_negatives.mine(df, df.where("false")).collect() == []
    one = df.where("vec_id = 0")
    assert hard_negatives.mine(one, one).collect() == []


def brute_nearest(vectors, ids, queries, k):
    at = {i: v for i, v in zip(ids, vectors, strict=True)}
    out = {}
    for q in queries:
        def score(i):
            total = 0.0
            for x, y in zip(at[q], at[i], strict=True):
                total += float(x) * float(y)
            return total

        out[q] = sorted(((-score(i), i) for i in ids if i != q))[:k]
    return out


def lists_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_recall_of_the_query(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    vectors = np.stack(table.embedding.to_numpy()).astype(float)
    found = lists_of(QUERIES["op13_nearest"](spark, sf_dir))
    ids = table.vec_id.tolist()
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    exact = brute_nearest(vectors.tolist(), ids, found, 20)
    assert sum(len(set(found[q]) & set(exact[q])) for q in found) >= 0.9 * sum(map(len, exact.values()))
    for q, rows in found.items():
        assert rows == sorted(rows) and set(rows) <= set(brute_nearest(vectors.tolist(), ids, [q], len(ids))[q])


def test_recall_in_clusters_and_small_tiles(spark, monkeypatch):
    """Buckets that overflow their tile are split, hot ones among many visitors too, and norms differ."""
    monkeypatch.setattr(nearest, "ASKED", 16)
    monkeypatch.setattr(nearest, "CELL", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 12)) * rng.uniform(0.3, 3, size=(20, 1))
    vectors = centres[np.minimum(rng.integers(0, 40, 1500), 19)] + rng.normal(scale=0.05, size=(1500, 12))
    df = frame(spark, vectors, [0] * 1500)
    found = lists_of(nearest.nearest(df, df.where("vec_id % 20 = 0"), 10, tile=64))
    exact = brute_nearest(vectors.tolist(), list(range(1500)), [i for i in range(1500) if i % 20 == 0], 10)
    assert sorted(found) == sorted(exact)
    assert sum(len({i for _, i in found[q]} & {i for _, i in exact[q]}) for q in exact) >= 0.9 * 10 * len(exact)
    for q, rows in found.items():
        scores = dict((i, s) for s, i in brute_nearest(vectors.tolist(), list(range(1500)), [q], 1500)[q])
        assert all(scores[i] == s for s, i in rows) and rows == sorted(rows)


def test_equal_vectors_tie_by_id(spark):
    hot, cold = [1.0, 2.0, 0.5], [0.5, 1.0, 0.25]
    ids = [*range(100, 400), *range(10)]
    df = frame(spark, [hot] * 300 + [cold] * 10, [0] * 310, ids)
    found = lists_of(nearest.nearest(df, df.where("vec_id in (5, 100, 390)"), 20))
    assert [i for _, i in found[390]] == list(range(100, 120))
    assert [i for _, i in found[100]] == list(range(101, 121))
    assert [i for _, i in found[5]] == list(range(100, 120))


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors, ids = [list(map(float, v)) for v in rng.normal(size=(15, 3))], list(range(15))
    bad = [*BAD, (1060, [0.0, 0.0, 0.0], 1)]
    df = frame(spark, [*vectors, *vectors[:5], *[b[1] for b in bad]], [None] * (20 + len(bad)), [*ids, *ids[:5], *[b[0] for b in bad]])
    found = lists_of(nearest.nearest(df, df, 20, success=0.9999))
    assert sorted(found) == ids
    for q, rows in found.items():
        assert q not in [i for _, i in rows] and len(rows) <= 14
    exact = brute_nearest(vectors, ids, ids, 20)
    assert sum(len(set(found[q]) & set(exact[q])) for q in ids) >= 0.9 * 15 * 14
    for empty in (nearest.nearest(df.where("false"), df), nearest.nearest(df, df.where("false"))):
        assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    one = df.where("vec_id = 1060 or vec_id = 3")
    assert nearest.nearest(one, one).collect() == []


def test_perturbed_buckets_come_likeliest_first():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(500, 6))
    norm = np.sqrt((sample**2).sum(axis=1)).max()
    hashes = nearest.Hashes(sample, 500_000, 1.0, norm, 20, 1, 3, 0.9)
    own, probes = hashes.buckets(sample[:5]), hashes.probes(sample[:5] * 0.5)
    assert own.shape == (5, 3)
    for q, tables in enumerate(probes):
        assert len(tables) == 3 and all(len(set(t.tolist())) == len(t) >= 1 for t in tables)
        wider = nearest.Hashes(sample, 500_000, 1.0, norm, 20, 1, 3, 0.97).probes(sample[q : q + 1] * 0.5)[0]
        assert all((w[: len(t)] == t).all() for t, w in zip(tables, wider, strict=True))


@pytest.mark.parametrize("width", [1, 5])
def test_unequal_lengths(spark, width):
    df = frame(spark, [[1.0] * width, [2.0], [0.5, 0.5]], [1, 1, 2])
    assert len(nearest.nearest(df, df, 2, success=0.9999).collect()) >= 3
    hard_negatives.mine(df, df).collect()
