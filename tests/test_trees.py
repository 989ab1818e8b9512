"""A tree grown by levels: planted splits, missing values, leaves that stay."""

import random

from assayer.operators import trees as R


def test_planted_tree(spark):
    """Colour tells one class, size the two others; rows without a colour or size go the heavier way; every row ends in one leaf."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        colour, size = rng.choice(["red", "blue", "green", "blue"]), rng.uniform(0, 10)
        y = "a" if colour == "red" else "b" if size < 5 else "c"
        rows.append((None if i % 50 == 0 else colour, None if i % 40 == 0 else size, rng.random(), y))
    rows.append(("red", 1.0, 0.5, None))
    df = spark.createDataFrame(rows, "colour string, size double, noise double, y string")
    nodes = {r.node: r for r in R.grow(df, ["size", "noise"], ["colour"], "y", ["a", "b", "c"], 2).collect()}
    root = nodes[""]
    assert root.n == 3000 and root.splits and root.feature in ("colour", "size")
    assert all(sum(nodes[k + b].n for b in "01" if k + b in nodes) == v.n for k, v in nodes.items() if v.splits)
    assert sum(v.n for v in nodes.values() if not v.splits) == 3000
    assert {v.feature for v in nodes.values() if v.splits} == {"colour", "size"}
    cut = [v.threshold for v in nodes.values() if v.feature == "size"]
    assert cut and all(4 < t < 6 for t in cut)
    table = spark.createDataFrame(list(nodes.values()), "node string, depth int, n long, counts array<long>, feature string, kind string, threshold double, value string, merit double, splits boolean")
    rules = R.rules(table, ["a", "b", "c"]).collect()
    assert sum(r.support for r in rules) == 3000
    red = next(r for r in rules if "colour == red" in r.rule and "size" not in r.rule or r.rule == "colour == red")
    assert red.prediction == "a" and red.confidence > 0.9
    best = max((r for r in rules if r.prediction == "c"), key=lambda r: r.support)
    assert "size > " in best.rule


def test_leaves_that_stay(spark):
    one = spark.createDataFrame([("x", 1.0, "a")] * 500, "k string, v double, y string")
    assert [(r.node, r.splits) for r in R.grow(one, ["v"], ["k"], "y", ["a", "b"]).collect()] == [("", False)]
    few = spark.createDataFrame([("x", 1.0, "a"), ("y", 2.0, "b")] * 50, "k string, v double, y string")
    assert [(r.node, r.n, r.splits) for r in R.grow(few, ["v"], ["k"], "y", ["a", "b"]).collect()] == [("", 100, False)]
    assert R.grow(few.limit(0), ["v"], ["k"], "y", ["a", "b"]).count() == 0
    assert R.rules(R.grow(few, ["v"], ["k"], "y", ["a", "b"]), ["a", "b"]).collect()[0].rule == ""
