"""Neighbours by chunks of entries: what several tasks find of a query is what one would, and nothing is dealt by features."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from assayer.functions import text as T
from assayer.operators import overlaps as O, similarity as S


def docs(spark, n=160):
    rng = random.Random(5)
    texts = [" ".join(["the", *(f"w{rng.randint(0, 25)}" for _ in range(rng.randint(1, 9)))]) for _ in range(n // 2)]
    rows = [(3 * i, rng.choice([*texts, "", "same"]), [f"k:c={rng.randint(0, 3)}"] * rng.randint(0, 1)) for i in range(n)]
    return S.with_vectors(spark.createDataFrame(rows, "doc_id long, text string, cats array<string>"), "doc_id", "text", F.col("cats"))


def rows_of(df):
    return sorted((r.id, r.entry, r.sim, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("search", [S.Search(), S.Search(k=10, cap=1000, exact=True), S.Search(earlier=False), S.Search(min_sim=0.05, k=30)])
def test_chunks(spark, monkeypatch, search):
    rows = docs(spark).persist()
    monkeypatch.setattr(S, "CANDIDATES", 12)
    whole, dealt, step = rows_of(S.neighbours(rows, rows.where("id % 2 = 0"), search)), [], S.overlapping
    monkeypatch.setattr(S, "CHUNK", 300)
    monkeypatch.setattr(S, "overlapping", lambda given, *a, **k: dealt.append((given.groupBy("kind").count().orderBy("kind").collect(), a[0])) or step(given, *a, **k))
    assert whole and rows_of(S.neighbours(rows, rows.where("id % 2 = 0"), search)) == whole
    (entries, queries), tasks = dealt[0]
    n = rows.count()
    assert tasks > 3 and entries[1] <= n / 2 * 2 * spark.sparkContext.defaultParallelism and queries[1] <= n * tasks / 2
    rows.unpersist()


@pytest.mark.parametrize("capacity", [1, 9, 2000])
def test_queries_of_a_block_in_parts(spark, monkeypatch, capacity):
    rows = docs(spark).persist()
    whole = rows_of(S.neighbours_as_of(rows, rows.where("id % 2 = 0"), capacity))
    monkeypatch.setattr(S, "ASKED", 2)
    monkeypatch.setattr(S, "MOST_TASKS", 3)
    assert whole and rows_of(S.neighbours_as_of(rows, rows.where("id % 2 = 0"), capacity)) == whole
    assert S.neighbours_as_of(rows, rows.limit(0), capacity).count() == 0 and S.neighbours(rows, rows.limit(0)).count() == 0
    rows.unpersist()


def texts(spark, n=160):
    rng = random.Random(7)
    words = [*(f"w{i}" for i in range(20)), "müsterlange", "beginnings", "beginner", "123456", "1234567x", "ﬀ"]
    some = [" ".join(["the", *(rng.choice(words) for _ in range(rng.randint(1, 9)))]) for _ in range(n // 2)]
    rows = [(3 * i, rng.choice([*some, "", None, "same", "...", "a, A; a a"]), [f"k:c={rng.randint(0, 3)}"] * rng.randint(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, cats array<string>")


def test_hashed_features_are_those_of_the_tokens(spark):
    rows = texts(spark).select(T.tokens(F.coalesce("text", F.lit(""))).alias("t"), O.joined(F.coalesce("text", F.lit(""))).alias("w")).select(T.token_features(F.col("t")).alias("f"), "w").collect()
    sizes, flat = O.hashed_features(pa.array([r.w for r in rows]))
    lists = np.split(flat, np.cumsum(sizes)[:-1])
    for r, hashes in zip(rows, lists):
        assert len(set(hashes)) == len(hashes) == len(r.f)
    for i, r in enumerate(rows):
        for j, q in enumerate(rows):
            assert len(set(r.f) & set(q.f)) == len(set(lists[i]) & set(lists[j]))


@pytest.mark.parametrize("search", [S.Search(), S.Search(k=10, cap=1000, exact=True), S.Search(min_sim=0.05, k=30)])
def test_texts_are_dealt_not_features(spark, monkeypatch, search):
    """The same neighbours, but what is shuffled are texts, and of entries that are not similar only how many have each overlap."""
    rows = texts(spark).persist()
    vectors, words = (f(rows, "doc_id", "text", F.col("cats")) for f in (S.with_vectors, S.with_texts))
    for candidates in (12, 200):
        monkeypatch.setattr(S, "CANDIDATES", candidates)
        want = rows_of(S.neighbours(vectors, vectors.where("id % 2 = 0"), search))
        dealt, step = [], S.overlapping
        monkeypatch.setattr(O, "PIECE", 200)
        monkeypatch.setattr(S, "CHUNK", 300)
        monkeypatch.setattr(S, "overlapping", lambda given, *a, **k: dealt.append((given, step(given, *a, **k))) or dealt[-1][1])
        assert want and rows_of(S.neighbours(words, words.where("id % 2 = 0"), search)) == want
        given, found = dealt[0]
        assert "words" in given.columns and "features" not in given.columns and found.where(F.array_min("sims") < search.min_sim).count() == 0
        monkeypatch.setattr(S, "CHUNK", 16_000_000)
        monkeypatch.setattr(S, "overlapping", step)
    assert rows_of(S.neighbours_as_of(words, words.where("id % 2 = 0"), 9)) == rows_of(S.neighbours_as_of(vectors, vectors.where("id % 2 = 0"), 9))
    rows.unpersist()


@pytest.mark.parametrize("name", ["memory_neighbours", "minimum_slice", "decide_documents", "patch_neighbours", "patch_trust"])
def test_queries_deal_texts(spark, monkeypatch, name):
    """No table of features is written, and none is shuffled: a query's searches get words."""
    dealt, step = [], S.overlapping
    monkeypatch.setattr(S, "overlapping", lambda given, *a, **k: dealt.append(given.columns) or step(given, *a, **k))
    driver.queries()[name](spark, "/root/testdata/sf0.001")
    assert dealt and all("words" in c and "features" not in c for c in dealt)
