"""The gate and the temperature as they were at each row, against plain replays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import calibration as C, patches as P


class Gate:
    """Weights of the patches by cell; an own cell not seen yet begins where its shared one stands."""

    def __init__(self):
        self.w = {}

    def weight(self, cell):
        return self.w.get(cell, self.w.get(cell.split(":")[0], 0.5))

    def learn(self, cell, lb, lp):
        for c in (cell.split(":")[0], cell):
            w = self.weight(c)
            a, b = (1 - w) * math.exp(-lb), w * math.exp(-lp)
            self.w[c] = (1 - P.SHARE) * b / (a + b) + P.SHARE / 2


@pytest.mark.parametrize("width", [40, 1000])
def test_gate_replay(spark, width):
    rng = random.Random(width)
    rows = [(3 * i, rng.choice(["0=:a", "0=:b", "3≠:a", "3≠:b", "4=:a"]), *((rng.expovariate(1), rng.expovariate(1)) if rng.random() < 0.6 else (None, None)), "kept") for i in range(60)]
    rows += [(999, "1≠:c", None, None, "never taught")]
    df = spark.createDataFrame(rows, "id long, cell string, lb double, lp double, note string")
    got = {r.id: (r.w, r.note) for r in P.gate_as_of(df, "id", F.floor(F.col("id") / width), F.col("lb"), F.col("lp")).collect()}
    gate = Gate()
    for i, cell, lb, lp, note in rows:
        assert got[i] == (pytest.approx(gate.weight(cell), abs=1e-10), note), (i, cell)
        if lb is not None:
            gate.learn(cell, lb, lp)
    assert len(got) == len(rows)
    fewer = df.withColumns({"lb": F.when(F.col("id") != 30, F.col("lb")), "lp": F.when(F.col("id") != 30, F.col("lp"))})
    undone, gate = {r.id: r.w for r in P.gate_as_of(fewer, "id", F.floor(F.col("id") / width), F.col("lb"), F.col("lp")).collect()}, Gate()
    for i, cell, lb, lp, _ in rows:
        assert undone[i] == pytest.approx(gate.weight(cell), abs=1e-10)
        if lb is not None and i != 30:
            gate.learn(cell, lb, lp)


def golden(samples):
    def nll(t):
        return sum(math.log(sum(math.exp(x / t) for x in logs)) - logs[y] / t for logs, y in samples) / len(samples)

    lo, hi = math.log(0.5), math.log(4.0)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(22):  # both points are computed anew: slower, the same search
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if nll(math.exp(a)) < nll(math.exp(b)) else (a, hi)
    return round(math.exp((lo + hi) / 2), 4)


def test_temperature_replay(spark):
    """Three options, an overconfident forecaster that mends; labels on two rows of three; a fit every fifty labels over five hundred."""
    rng = random.Random(4)
    rows = []
    for i in range(1100):
        p = [rng.random() ** (4 if i < 500 else 1) for _ in range(3)]
        p = [x / sum(p) for x in p]
        rows.append((i, p, rng.randrange(3) if i < 300 else rng.choices(range(3), p)[0]) if i % 3 else (i, p, None))
    df = spark.createDataFrame(rows, "id long, p array<double>, y int")
    got = {r.id: r.temperature for r in C.temperature_as_of(df, "id", F.col("p"), F.col("y"), F.floor(F.col("id") / 64)).collect()}
    seen, t = [], 1.0
    for i, p, y in rows:
        assert got[i] == pytest.approx(t, abs=2e-4), i
        if y is not None:
            seen.append(([math.log(max(x, 1e-12)) for x in p], y))
            if len(seen) % C.REFIT == 0 and len(seen) >= C.MIN_SAMPLES:
                t = golden(seen[-C.WINDOW :])
    assert got[200] > 1.5 and len(set(got.values())) > 3


def test_temperature_of_few_labels(spark):
    df = spark.createDataFrame([(i, [0.9, 0.1], 0) for i in range(49)], "id long, p array<double>, y int")
    assert {r.temperature for r in C.temperature_as_of(df, "id", F.col("p"), F.col("y"), F.lit(0)).collect()} == {1.0}
    assert C.temperature_as_of(df.limit(0), "id", F.col("p"), F.col("y"), F.lit(0)).count() == 0
