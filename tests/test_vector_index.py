"""The inverted file against the exact search: the same with all lists probed, recall with few."""

from pathlib import Path

import numpy as np
import pytest

from assayer.operators import similarity as S, vector_index as X

SCHEMA = "vec_id long, embedding array<float>"


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query"], []).append((r["rank"], r["vec_id"], round(r["sim"], 6)))
    return {q: sorted(v) for q, v in out.items()}


def planted(spark, n, seed=3):
    """Vectors about 40 directions, one of them of a third of all rows, and groups of copies."""
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(40, 16))
    rows = [(i, (ways[0 if i % 3 == 0 else rng.integers(40)] + 0.6 * rng.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 2][1]) for i in range(30)] + [(None, rows[0][1]), (n + 99, None), (n + 100, [0.0] * 16)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def recall(want, got):
    """By similarity, so that ties count for either: a hit reaches the least one of the exact result."""
    hits = sum(sum(s >= w[-1][2] - 1e-6 for _, _, s in got.get(q, [])) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("limits", [(20_000, 4096), (50, 7)])
def test_all_lists_give_the_exact_result(spark, monkeypatch, limits):
    monkeypatch.setattr(X, "LIST_ROWS", limits[0])
    monkeypatch.setattr(X, "LIST_QUERIES", limits[1])
    df = planted(spark, 900)
    some = df.where("vec_id % 20 = 0")
    index = X.vector_index(df, 12)
    assert index.rows.count() == 931 and len(index.centres) == 12
    assert by_query(X.index_neighbours(some, index, probes=12)) == by_query(S.vector_neighbours(some, df.where("vec_id is not null")))


def test_recall_of_few_probes(spark):
    df = planted(spark, 4000)
    some = df.where("vec_id % 50 = 0")
    index = X.vector_index(df)
    want = by_query(S.vector_neighbours(some, df.where("vec_id is not null")))
    got = by_query(X.index_neighbours(some, index))
    assert len(index.centres) == 64 and set(got) == set(want) and 1 <= X.probes_for(index, 0.9) <= 8
    assert recall(want, got) >= 0.9
    assert by_query(X.index_neighbours(some.repartition(3), X.vector_index(df.repartition(3)))) == got


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_recall_of_the_query(spark):
    from assayer.plans import learning_queries, registry  # noqa: F401  (registers)

    d = "/root/testdata/sf0.1"
    want, got = (by_query(registry.QUERIES[n](spark, d)) for n in ("embedding_knn", "embedding_index_knn"))
    assert set(got) == set(want) and recall(want, got) >= 0.9


def test_probes_for_a_recall(spark):
    """Vectors without clusters: the probes measured on some rows give the recall for others."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=24).tolist()) for i in range(2500)], SCHEMA).repartition(4)
    index, some = X.vector_index(df), df.where("vec_id % 50 = 0")
    few, many = X.probes_for(index, 0.5), X.probes_for(index, 0.95)
    assert few < many <= 50 and X.probes_for(index, 1.0) <= 50
    assert recall(by_query(S.vector_neighbours(some, df)), by_query(X.index_neighbours(some, index, probes=many))) >= 0.9


def test_empty_tables(spark):
    df = planted(spark, 60)
    none = X.vector_index(df.limit(0))
    assert none.rows.count() == 0 and X.probes_for(none) == 1 and X.index_neighbours(df, none).count() == 0
    assert X.index_neighbours(df.limit(0), X.vector_index(df)).count() == 0
