"""Sums that fade, against plain sums, over blocks that a half-life spans and blocks that outlast it."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import patches as P
from assayer.operators.running import faded


@pytest.mark.parametrize("half_life, width, spread", [(30.0, 7, 3), (3.0, 20_000, 400), (0.5, 100, 50)])
def test_faded_by_brute_force(spark, half_life, width, spread):
    rng = random.Random(width)
    rows, at = [], 0
    for i in range(120):
        at += rng.randrange(spread)  # places repeat
        rows.append((rng.choice("ab"), at, rng.random(), i))
    df = spark.createDataFrame(rows, "k string, seq long, v double, i long")
    got = {r.i: (r.s, r.n) for r in faded(df, ["k"], "seq", {"s": F.col("v"), "n": F.lit(1)}, half_life, width).collect()}
    for k, t, _, i in rows:
        before = [(v, 0.5 ** ((t - u) / half_life)) for key, u, v, _ in rows if key == k and u <= t]
        assert got[i] == (pytest.approx(sum(v * f for v, f in before)), pytest.approx(sum(f for _, f in before))), i


def test_weights_at_any_time_are_those_of_that_time(spark):
    """A history's weights equal ``annotator_weights`` of the comparisons up to each time."""
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), 11 * i, float(x), 1.0 - x) for i in range(40) for x in [rng.random() < 0.7]]
    compared = spark.createDataFrame(rows, "annotator string, seq long, agree double, disagree double")
    times = spark.createDataFrame([(55,), (300,), (301,), (5000,)], "now long")
    got = {(r.now, r.annotator): r.weight for r in P.weight_history(compared, times).collect()}
    for (now,) in times.collect():
        want = {r.annotator: r.weight for r in P.annotator_weights(compared.where(F.col("seq") <= now), int(now)).collect()}
        assert {a: w for (t, a), w in got.items() if t == now} == pytest.approx(want)
