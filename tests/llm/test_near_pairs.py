"""Near copies around a hub that they are not linked to: the work grows with their number, the components are those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.llm import near_dups


def family(n, seed=3, size=400):
    """A hub of about 0.8, and ``n`` copies of another text that differ in two words each."""
    draw = random.Random(seed)
    hub = [f"w{i}" for i in range(size)]
    other = hub[:]
    for i in range(20, size, 42):  # each changed word changes five shingles
        other[i] = f"x{i}"
    rows = [(0, " ".join(hub))]
    for k in range(1, n + 1):
        own = other[:]
        own[draw.randrange(size)] = f"own{k}"
        rows.append((k, " ".join(own)))
    return rows


def share(one, other):
    one, other = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (one, other))
    return len(one & other) / len(one | other)


def work(spark, monkeypatch, n, least_percent=85):
    """Components of the hub's bucket, with the comparisons that pivots and pairs make."""
    made = {"pivot": 0, "pairs": 0}
    pivot, pairs = near_dups._pivot_pairs, near_dups._all_pairs

    def count_pivot(apart, turn, percent):
        made["pivot"] += apart.count()
        return pivot(apart, turn, percent)

    def count_pairs(apart, percent):
        sizes = apart.groupBy("hub", "element").count()
        made["pairs"] += sizes.agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0]
        return pairs(apart, percent)

    monkeypatch.setattr(near_dups, "_pivot_pairs", count_pivot)
    monkeypatch.setattr(near_dups, "_all_pairs", count_pairs)
    rows = family(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = docs.select(F.lit(1).alias("bucket"), F.col("doc_id").alias("node"))
    minima = docs.limit(0).select(F.col("doc_id").alias("node"), F.lit(b"").alias("set_key"), F.array(F.lit(1).cast("short")).alias("minima"))
    out = near_dups.link_components(docs, members, minima, None, least_percent, 5)
    found = {r.node: r.component for r in out.collect()}
    monkeypatch.undo()
    return rows, found, made


def test_comparisons_grow_with_the_copies(spark, monkeypatch):
    totals = []
    for n in (100, 200, 400):
        rows, found, made = work(spark, monkeypatch, n)
        assert share(rows[0][1], rows[1][1]) < 0.85 < share(rows[1][1], rows[n][1])
        assert found == {k: 1 for k in range(2, n + 1)}  # node 1 stands for itself: the hub has no link, the copies are one component
        totals.append(made["pivot"] + made["pairs"])
    assert totals[2] < 5 * totals[0], totals


@pytest.mark.parametrize("turns", [0, 1, 2])
def test_pivots_change_no_component(spark, monkeypatch, turns):
    """Random families in one bucket: every number of pivot turns gives the components of all pairs."""
    draw = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(4):
        start = base[:]
        for i in draw.sample(range(120), 4):
            start[i] = f"f{draw.random()}"
        for _ in range(8):
            own = start[:]
            for i in draw.sample(range(120), draw.randrange(3)):
                own[i] = f"o{draw.random()}"
            texts.append(" ".join(own))
    texts = sorted(set(texts))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if share(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = docs.select(F.lit(1).alias("bucket"), F.col("doc_id").alias("node"))
    minima = docs.limit(0).select(F.col("doc_id").alias("node"), F.lit(b"").alias("set_key"), F.array(F.lit(1).cast("short")).alias("minima"))
    monkeypatch.setattr(near_dups, "TURNS", turns)
    found = {r.node: r.component for r in near_dups.link_components(docs, members, minima, None, 80, 5).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == [root(i) for i in range(len(texts))]


def test_signatures_drop_only_the_hopeless(spark):
    one, near, far = list(range(150)), list(range(120)) + [-1] * 30, list(range(60)) + [-1] * 90
    minima = spark.createDataFrame([(1, b"1", one), (2, b"2", near), (2, b"2", near), (3, b"3", far)], "node long, set_key binary, minima array<short>")
    pairs = spark.createDataFrame([(1, 2, False, 0), (1, 3, False, 0), (2, 3, True, 0)], "a long, b long, wide boolean, part long")
    kept = near_dups.verified(pairs, minima, 80).select("a", "b").collect()
    assert {tuple(r) for r in kept} == {(1, 2), (2, 3)}
