"""The linear learner's one pass, and reasons made of one row of an example, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from assayer.functions import text as T
from assayer.operators import hashed as H, learners as L

ROWS = [(1, "a", 1.0, ["x", "y"]), (2, "b", 1.0, ["y", "z", "t"]), (3, "a", 2.0, ["t"]), (4, None, 1.0, ["x", "z", "new", "u"])]


def frames(spark):
    x = spark.createDataFrame([(i, f, 1 / math.sqrt(len(fs))) for i, _, _, fs in ROWS for f in fs] + [(i, "bias", 1.0) for i, *_ in ROWS], "id long, f string, v double")
    return x, spark.createDataFrame([r[:3] for r in ROWS], "id long, label string, weight double").where("label is not null")


def test_first_weights_are_those_of_one_pass(spark):
    x, labels = frames(spark)
    want = {r.f: r.w for r in L.linear_weights(x, labels, ["a", "b"]).collect()}
    got = {r.f: r.w for r in L.first_weights(x.join(labels, "id"), ["a", "b"]).collect()}
    assert got.keys() == want.keys() and "new" not in got
    assert all(got[f] == pytest.approx(want[f]) for f in want)


@pytest.mark.parametrize("options", [["a", "b"], ["a", "b", "c"]])
def test_reasons_meet_the_weights_once(spark, monkeypatch, options):
    monkeypatch.setattr(L, "MOST_FOR", 2)
    monkeypatch.setattr(L, "MOST_AGAINST", 1)
    x, labels = frames(spark)
    w = L.linear_weights(x, labels, options)
    found = L.linear_reasons(x, w, options)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") - plan.count("JoinHint") <= 2 and "Window" not in plan  # labels to features, weights to features
    weights, want = {r.f: r.w for r in w.collect()}, []
    for i, _, _, fs in ROWS:
        vs = {f: 1 / math.sqrt(len(fs)) for f in fs if f in weights} | {"bias": 1.0}
        z = [sum(weights[f][o] * v for f, v in vs.items()) for o in range(len(options))]
        at = z.index(max(z))
        c = {f: v * (weights[f][at] - (sum(weights[f]) - weights[f][at]) / (len(options) - 1)) for f, v in vs.items() if f != "bias"}
        for side, sign, most in (("for", 1, 2), ("against", -1, 1)):
            best = sorted((-round(abs(v), 9), f) for f, v in c.items() if sign * v > L.NOTED)[:most]
            want += [(i, f, side, k + 1) for k, (_, f) in enumerate(best)]
    assert sorted((r.id, r.f, r.side, r["rank"]) for r in found.collect()) == sorted(want)


def test_familiar_share_of_hashed_features(spark):
    x, labels = frames(spark)
    w = L.linear_weights(x, labels, ["a", "b"])
    hashed = lambda df: df.withColumn("f", F.xxhash64("f"))
    want = {r.id: r.familiarity for r in L.familiar_share(x, w).collect()}
    assert {r.id: r.familiarity for r in L.familiar_share(hashed(x.where("f <> 'bias'")), hashed(w)).collect()} == pytest.approx(want)


def test_token_hashes_are_those_of_the_features(spark):
    texts = spark.createDataFrame([("one two two one two",), ("Einzelne Wörter, 1234567 99 wörtlich wörter",), ("x",), ("",), (None,)], "text string")
    rows = texts.select(T.tokens(F.coalesce("text", F.lit(""))).alias("t")).select(F.transform(T.token_features(F.col("t")), lambda f: F.xxhash64(f)).alias("a"), T.token_hashes(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and [len(r.b) for r in rows[2:]] == [1, 0, 0]


@pytest.mark.parametrize("name, texts", [("familiarity", 2), ("linear_predict", 2), ("linear_evidence", 1), ("linear_explanations", 2)])
def test_features_are_made_once_for_each_use(spark, name, texts):
    """Once for all texts and once for labelled ones: no filter on their number makes them again."""
    found = driver.queries()[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == texts and plan.count("array_distinct") == texts
    if name == "familiarity":
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tasks, block, most", [(1, 4096, 4_000_000), (5, 4096, 4_000_000), (7, 2, 5)])
def test_hashed_sums_are_those_of_rows(spark, monkeypatch, tasks, block, most):
    """No feature is a row of its own, and none is put in order or held: sums and shares are those of the rows."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "MOST", most)
    x, labels = frames(spark)
    x = x.where("f <> 'bias'")
    docs = spark.createDataFrame([(i, fs) for i, _, _, fs in ROWS] + [(9, [])], "id long, fs array<string>").withColumn("fs", F.transform("fs", lambda f: F.xxhash64(f)))
    w = L.linear_weights(x, labels, ["a", "b"])
    examples = docs.join(labels, "id").select(L.first_slopes(["a", "b"]).alias("slopes"), "fs")
    examples = spark.createDataFrame(examples.collect(), examples.schema)
    found = H.hashed_sums(docs, examples, 2, tasks, L.KNOWN)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = {r.id: r for r in found.groupBy("id", "size").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.array(F.sum("z0"), F.sum("z1")).alias("z")).collect()}
    share = {r.id: r.familiarity for r in L.familiar_share(x, w).collect()}
    z = {r.id: r.z for r in x.join(w, "f").groupBy("id").agg(F.array(*(F.sum(F.get("w", i) * F.col("v")) for i in range(2))).alias("z")).collect()}
    assert {i: (r.size, r.n) for i, r in got.items()} == {i: (len(fs), len(fs)) for i, _, _, fs in ROWS} | {9: (0, 0)}
    assert all(r.known / r.n == pytest.approx(share[i]) and r.z == pytest.approx(z[i]) for i, r in got.items() if i != 9)
    alone = H.hashed_sums(docs, examples.limit(0), 2, tasks).agg(F.sum("n"), F.sum("known"), F.sum("z0")).first()
    assert tuple(alone) == (sum(len(fs) for *_, fs in ROWS), 0, 0.0)
