"""Running sums and trailing windows that no single task holds: sums by block, a prefix over blocks, then rows within a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, keys: list[str], block: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``rank`` and the running total of each of ``sums``, in ``order`` within ``keys``.

    ``block`` must never fall along the order; one block of one key is the most that a task sorts.
    """
    rows = df.withColumn("_block", block).withColumns({f"_v_{k}": v for k, v in sums.items()})
    names = list(sums)
    by_block = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), *(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in names))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s0_{k}") for k in names))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_r", F.row_number().over(inside)).withColumns({f"_c_{k}": F.sum(f"_v_{k}").over(inside) for k in names}).join(starts, [*keys, "_block"])
    out = out.withColumn("rank", (F.col("_n0") + F.col("_r")).cast("long")).withColumns({k: F.col(f"_s0_{k}") + F.col(f"_c_{k}") for k in names})
    return out.select(*[c for c in df.columns if c not in names], "rank", *names)


def trailing(df: DataFrame, keys: list[str], block: Column, order: list[Column], sums: dict[str, Column], size: int) -> DataFrame:
    """As ``running``, but over the last ``size`` rows: the running total less the one ``size`` rows before."""
    run = running(df, keys, block, order, sums)
    old = run.select(*keys, (F.col("rank") + size).alias("rank"), *(F.col(k).alias(f"_old_{k}") for k in sums))
    out = run.join(old, [*keys, "rank"], "left").withColumns({k: F.col(k) - F.coalesce(f"_old_{k}", F.lit(0)) for k in sums})
    return out.withColumn("n", F.least("rank", F.lit(size)).cast("long")).drop(*(f"_old_{k}" for k in sums))


def by_level(df: DataFrame, keys: list[str], level: str, sums: dict[str, Column], step: float = 0.005) -> DataFrame:
    """Totals of each distinct ``level``, and running totals (``upto_``) from the highest level down: tie groups stay whole.

    Rows are summed up by level before they meet, then by blocks of ``step``; a task orders one key's levels of one block.
    """
    rows = df.groupBy(*keys, level).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    return running(rows, keys, F.floor(-F.col(level) / step), [F.desc(level)], {f"upto_{k}": F.col(k) for k in sums}).drop("rank")


def running_least(df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the least ``value`` so far in ``order`` within ``keys``, by blocks as ``running``; nulls don't count."""
    rows = df.withColumns({"_block": block, "_v": value})
    by_block = rows.groupBy(*keys, "_block").agg(F.min("_v").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select(*keys, "_block", F.min("_m").over(before).alias("_m0"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_c", F.min("_v").over(inside)).join(starts, [*keys, "_block"])
    return out.withColumn(name, F.least("_m0", "_c")).drop("_block", "_v", "_c", "_m0")


def faded(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], half_life: float, width: int = 20_000) -> DataFrame:
    """``df`` with running totals of ``sums`` that lose half in each ``half_life`` of ``order`` (a whole number), rows of the same place included.

    Within a block of ``width`` places values grow instead of fading, so that they add up; a block takes over what the blocks before it have left.
    What is 1100 half-lives old is below the least number there is, so a block looks at a bounded number of blocks before it.
    """
    rate, names = 1 / half_life, list(sums)
    width = max(1, min(width, int(500 * half_life)))  # so that nothing grows beyond a double
    rows = df.withColumn("_block", F.floor(F.col(order) / width)).withColumns({f"_v_{k}": v.cast("double") for k, v in sums.items()})
    since = lambda block: (F.col(order) - block * width) * rate
    grown = rows.withColumns({f"_v_{k}": F.col(f"_v_{k}") * F.pow(F.lit(2.0), since(F.col("_block"))) for k in names})
    ends = grown.groupBy(*keys, "_block").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in names))
    reach = int(1100 * half_life / width) + 1
    later = ends.select(*keys, F.col("_block").alias("_from"), F.explode(F.sequence(F.col("_block") + 1, F.col("_block") + reach)).alias("_block"), *(f"_s_{k}" for k in names))
    left = F.pow(F.lit(2.0), (F.col("_from") - F.col("_block")) * width * rate)
    carried = later.join(ends.select(*keys, "_block"), [*keys, "_block"], "left_semi").groupBy(*keys, "_block").agg(*(F.sum(F.col(f"_s_{k}") * left).alias(f"_c_{k}") for k in names))
    upto = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = grown.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(upto) for k in names}).join(carried, [*keys, "_block"], "left")
    total = lambda k: (F.col(f"_r_{k}") + F.coalesce(f"_c_{k}", F.lit(0.0))) * F.pow(F.lit(2.0), -since(F.col("_block")))
    return out.withColumns({k: total(k) for k in names}).select(*[c for c in df.columns if c not in names], *names)
