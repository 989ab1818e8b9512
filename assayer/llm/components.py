"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.llm.tables import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` for every vertex that has an edge and isn't the least of its component.

    ``edges`` has two columns of comparable ids, in any order, repeats and loops allowed; rows with a null are ignored.
    A component's name is its least id; ids without a row are their own component.  Each round is a few joins and
    grouped minima over the edges, written to the shared folder; vertices of any degree are summed up before a shuffle.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null").where("u <> v").distinct()
    now, before = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, last = state, now
        now = written(_small_star(_large_star(now)), "edges")
        dropped(now.sparkSession, last)
