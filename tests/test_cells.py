"""Dense neighbours: a task holds a bounded number of similarities, and what it gives is the same."""

import numpy as np

from assayer.operators import similarity as S


def test_similarities_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-1, 2, (300, 4)).astype(float))]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    x = np.array([v for _, v in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = set()
    for i in range(0, 300, 7):
        s = np.round(x @ x[i], 9)
        s[i] = -2
        want |= {(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(300), -s))[:5])}
    whole = {(r["query"], r.vec_id, r["rank"]) for r in S.vector_neighbours(df.where("vec_id % 7 = 0"), df).collect()}
    monkeypatch.setattr(S, "CELLS", 1000)
    parts = {(r["query"], r.vec_id, r["rank"]) for r in S.vector_neighbours(df.where("vec_id % 7 = 0"), df).collect()}
    assert whole == want and parts == want
