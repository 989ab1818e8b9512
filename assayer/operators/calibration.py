"""Temperatures: the one that suits the latest labels best, at the end of the log or as it was at each row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import numbers as N
from assayer.operators.running import running

#: Labels a fit looks at, labels between fits, labels before the first, bounds of the temperature, steps of the search.
WINDOW, REFIT, MIN_SAMPLES, LEAST, MOST, STEPS = 500, 50, 30, 0.5, 4.0, 22
_GOLDEN = (math.sqrt(5) - 1) / 2


def fitted_temperature(samples: Column) -> Column:
    """The temperature of the least mean log loss, by golden-section search on its logarithm, to four decimals.

    ``samples`` is an array, of WINDOW entries at most, of structs ``logs`` (logarithms of a forecast's probabilities) and ``y`` (the place of what came, from 0).
    """
    def loss(log_t: Column) -> Column:
        t = F.exp(log_t)
        each = lambda s: F.ln(N.total(F.transform(s["logs"], lambda x: F.exp(x / t)))) - F.get(s["logs"], s["y"]) / t
        return F.aggregate(samples, F.lit(0.0), lambda a, s: a + each(s)) / F.size(samples)

    def state(lo, hi, a, b, fa, fb) -> Column:
        return F.struct(*(c.alias(k) for c, k in zip((lo, hi, a, b, fa, fb), ("lo", "hi", "a", "b", "fa", "fb"))))

    def step(s: Column, _: Column) -> Column:
        left = s["fa"] < s["fb"]
        lo, hi = F.when(left, s["lo"]).otherwise(s["a"]), F.when(left, s["b"]).otherwise(s["hi"])
        x = F.when(left, hi - _GOLDEN * (hi - lo)).otherwise(lo + _GOLDEN * (hi - lo))
        return state(lo, hi, F.when(left, x).otherwise(s["b"]), F.when(left, s["a"]).otherwise(x), F.when(left, loss(x)).otherwise(s["fb"]), F.when(left, s["fa"]).otherwise(loss(x)))

    lo, hi = math.log(LEAST), math.log(MOST)
    a, b = hi - _GOLDEN * (hi - lo), lo + _GOLDEN * (hi - lo)
    start = state(*(F.lit(x) for x in (lo, hi, a, b)), loss(F.lit(a)), loss(F.lit(b)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: F.round(F.exp((s["lo"] + s["hi"]) / 2), 4))


def sample(probs: Column, place: Column) -> Column:
    """What ``fitted_temperature`` takes of a forecast and the place, from 0, of what came."""
    return F.struct(F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(N.TINY)))).alias("logs"), place.cast("int").alias("y"))


def temperature_as_of(rows: DataFrame, order: str, probs: Column, place: Column, block: Column) -> DataFrame:
    """``rows`` with ``temperature`` as it was before each: fitted anew after each REFIT labels to the WINDOW newest; 1 before the first fit.

    ``place`` is null where no label came.  A label goes to the fits that look at it, ten at most, and each fit is one row of WINDOW
    samples; labels are counted by blocks of the log.
    """
    run = running(rows.withColumns({"_p": probs, "_y": place}), [], block, [F.asc(order)], {"_upto": F.when(F.col("_y").isNotNull(), 1).otherwise(0)})
    first = F.ceil(F.col("_upto") / REFIT)
    given = run.where("_y is not null").select("_upto", sample(F.col("_p"), F.col("_y")).alias("s"), F.explode(F.sequence(first, first + WINDOW // REFIT - 1)).alias("_fit"))
    fits = given.groupBy("_fit").agg(F.array_sort(F.collect_list(F.struct("_upto", "s"))).alias("all"), F.max("_upto").alias("_last"))
    fits = fits.where((F.col("_last") == F.col("_fit") * REFIT) & (F.size("all") >= MIN_SAMPLES)).select("_fit", fitted_temperature(F.transform("all", lambda x: x["s"])).alias("temperature"))
    before = F.col("_upto") - F.when(F.col("_y").isNotNull(), 1).otherwise(0)
    out = run.withColumn("_fit", F.floor(before / REFIT)).join(fits, "_fit", "left")
    return out.select(*rows.columns, F.coalesce("temperature", F.lit(1.0)).alias("temperature"))
