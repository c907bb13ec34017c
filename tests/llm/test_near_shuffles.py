"""What near-duplicate removal sends around: whole rows once, and no table of the driver's for a join in a loop."""

from runlens.llm import near_dups

WORDS = " ".join(f"w{i}" for i in range(40))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_are_shuffled_once(spark):
    rows = [(1, WORDS), (1, WORDS), (2, WORDS), (3, WORDS + " end"), (None, "alone"), (None, "alone"), (4, None)]
    found = near_dups.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in found.collect()) == [(0, "alone"), (1, "w0 w1"), (4, "")]
    text = plan(found)
    top = text[: text.index("LeftSemi")]
    assert "Window" in top and "Exchange" not in top  # the join's shuffle serves the window


def test_joins_of_a_round_are_not_broadcast(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 4)], "u long, v long")
    found = near_dups._stars(edges)
    assert {(2, 1), (5, 4)} <= set(map(tuple, found.collect()))
    assert "Broadcast" not in plan(found)  # as it was run


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_a_round_of_components_is_two_shuffles(spark):
    assert shuffles(near_dups._stars(spark.createDataFrame([(3, 2), (2, 1), (5, 4)], "u long, v long"))) == 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 70)]
    star = [(200, n) for n in range(100, 200)]
    links = spark.createDataFrame([*chain, *star, *star, (300, 301), (301, 300), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in near_dups.components(links).collect()}
    assert found == {n: 1 for n in range(2, 71)} | {n: 100 for n in range(101, 201)} | {301: 300}


def test_unsettled_nodes(spark):
    count = [near_dups._unsettled(spark.createDataFrame(rows, "u long, v long")) for rows in ([(3, 1), (2, 1)], [(3, 1), (3, 2)], [(3, 2), (2, 1)])]
    assert count == [0, 1, 1]
