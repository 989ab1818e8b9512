"""Splits and samples by hash, and the scores of forecasts on labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import numbers as N

#: Tenths of a split that are tested and validated on.
TEST, VALIDATION = 0, 1


def split_of(key: Column, by: str = "crc32") -> Column:
    """``test``, ``val`` or ``train``, one, one and eight tenths, by the key's hash (``crc32`` or ``md5``)."""
    h = F.crc32(key.cast("binary")) if by == "crc32" else F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(h % 10 == TEST, "test").when(h % 10 == VALIDATION, "val").otherwise("train")


def per_class(rows: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows of each class, in order of the hash of ``seed`` and ``key``; Spark keeps k rows of a class before the shuffle."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(h, key))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def evaluation(rows: DataFrame, probs: str, label: str, options: Sequence[str], threshold: float = 0.6, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, labels, accuracy, nll, brier, answered_accuracy, coverage`` of forecasts in option order; rows with another label are left out."""
    names = F.array(*map(F.lit, options))
    place = F.array_position(names, F.col(label)).cast("int") - 1
    scored = rows.where(F.col(label).isin(*options)).withColumns({"_own": F.get(probs, place), "_ok": (N.first_largest(F.col(probs)) - 1 == place).cast("int"), "_given": (F.array_max(probs) >= threshold).cast("int")})
    square = F.aggregate(F.col(probs), F.lit(0.0), lambda a, p: a + p * p)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("labels"), F.avg("_ok").alias("accuracy"), F.avg(N.log_loss(F.col("_own"))).alias("nll"), F.avg(square - 2 * F.col("_own") + 1).alias("brier"),
        F.avg(F.when(F.col("_given") == 1, F.col("_ok"))).alias("answered_accuracy"), F.avg("_given").alias("coverage"),
    )
