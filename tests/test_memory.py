"""The memory as it was when each query came, against a replay row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import similarity as S


def feats(text):
    w = text.split()
    return {f"w:{x}" for x in w} | {f"b:{a}_{b}" for a, b in zip(w, w[1:])} | {f"p5:{x[:5]}" for x in w if len(x) > 5}


class Memory:
    """The newest labels, and the newest answers of exact states, one after another."""

    def __init__(self, capacity, exact):
        self.capacity, self.exact, self.items, self.answers = capacity, exact, [], []

    def near(self, state, cats):
        q, items = feats(state), self.items[-self.capacity :]
        limit = max(5, min(S.CAPACITY, len(items) // 4))
        df = {}
        for _, t, c, *_ in items:
            for f in t | c:
                df[f] = df.get(f, 0) + 1
        rare = {f for f in q | cats if df.get(f, 0) <= limit}
        over = sorted((-len(rare & (e[1] | e[2])), e[0]) for e in items)
        close = {i for o, i in over[: S.CANDIDATES] if o < 0}
        unit = lambda t, c: math.sqrt((1 if t else 0) + len(c))
        found = [(-round((len(q & t) / math.sqrt(max(1, len(q)) * max(1, len(t))) + len(cats & c)) / (unit(q, cats) * unit(t, c)), 9), i) for i, t, c, *_ in items if i in close]
        return [(i, -s) for s, i in sorted(x for x in found if -x[0] >= S.MIN_SIM)[: S.K]]

    def same(self, state):
        said = [(w, i, label) for i, s, w, label in self.answers[-self.exact :] if s == state]
        return max(said)[2] if said else None

    def learn(self, i, state, cats, label, weight):
        self.items.append((i, feats(state), cats))
        self.answers.append((i, state, weight, label))


@pytest.mark.parametrize("capacity, exact, n", [(7, 11, 160), (40, 13, 160), (2000, 8000, 60), (1, 1, 40)])
def test_replay(spark, monkeypatch, capacity, exact, n):
    monkeypatch.setattr(S, "PLACES", 13)
    monkeypatch.setattr(S, "HOT", 5)
    monkeypatch.setattr(S, "CANDIDATES", 9)
    rng = random.Random(capacity)
    texts = [" ".join(["the", *(f"w{rng.randint(0, 20)}" for _ in range(rng.randint(1, 8)))]) for _ in range(n // 4)]
    rows = [(3 * i, rng.choice(texts + ["", "same"] * 5), sorted({f"k:c={rng.randint(0, 3)}" for _ in range(rng.randint(0, 2))}), rng.choice(["x", "y"]) if rng.random() < 0.6 else None, rng.choice([1.0, 1.0, 2.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cats array<string>, label string, weight double")
    docs = S.with_vectors(df, "doc_id", "text", F.col("cats")).persist()
    labelled = docs.where("label is not null")
    near = {}
    for r in S.neighbours_as_of(docs, labelled, capacity).orderBy("id", "rank").collect():
        near.setdefault(r.id, []).append((r.entry, r.sim))
    same = {r.id: r.exact for r in S.exact_answers(docs, labelled, ["x", "y"], exact).collect()}
    memory = Memory(capacity, exact)
    for i, state, cats, label, weight in rows:
        assert near.get(i, []) == [(e, pytest.approx(s)) for e, s in memory.near(state, set(cats))], i
        said = memory.same(state)
        assert (same.get(i) is None) == (said is None) and (said is None or same[i] == pytest.approx([0.95, 0.05] if said == "x" else [0.05, 0.95])), i
        if label is not None:
            memory.learn(i, state, set(cats), label, weight)
    docs.unpersist()


def test_thousands_of_labels(spark):
    """Beyond the capacity: each of 6,000 labels meets the 2,000 before it, the first ones and the last alike."""
    rng = random.Random(8)
    words = [[f"t{i % 3000}", f"u{rng.randrange(1500)}"] for i in range(6000)]
    docs = S.with_vectors(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string"), "doc_id", "text").persist()
    found = {}
    for r in S.neighbours_as_of(docs, docs).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append(r.entry)
    whole = [{f"w:{a}", f"w:{b}", f"b:{a}_{b}"} for a, b in words]
    by_word = {}
    for i, (_, u) in enumerate(words):
        close = [e for e in by_word.get(u, []) if i - e <= 2000]  # t comes again after 3,000 labels only
        assert found.get(i, []) == [], (i, close)  # one of three features is below the least similarity
        by_word.setdefault(u, []).append(i)
    near = S.neighbours_as_of(docs, docs, search=S.Search(min_sim=0.3)).orderBy("id", "rank").collect()
    got = {}
    for r in near:
        got.setdefault(r.id, []).append(r.entry)
    by_word = {}
    for i, (_, u) in enumerate(words):
        assert got.get(i, []) == [e for e in by_word.get(u, []) if i - e <= 2000][: S.K], i
        by_word.setdefault(u, []).append(i)
    assert whole and abs(sum(i < 3000 for i in got) - sum(i >= 3000 for i in got)) < 600
    docs.unpersist()


def test_counts_before(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x"), (9, None)], "id long, label string").withColumn("seq", F.col("id"))
    assert {r.id: r.counts for r in S.counts_before(df, df, ["x", "y"]).collect()} == {1: [0, 0], 2: [1, 0], 3: [1, 0], 4: [1, 1], 9: [2, 1]}
