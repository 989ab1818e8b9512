"""Versions of the log: what was active at a position of it, where rollbacks are entries of the log like others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators.tables import written

#: Up to so many spans are broadcast; beyond it spans are copied to so many parts of a key's events.
BROADCAST_SPANS, PARTS = 100_000, 64


def _last_rollback(asked: DataFrame, rollbacks: DataFrame, key: str) -> DataFrame:
    """``asked`` with ``back``, the last of its key's rollbacks at or before ``high``; a key has as many rows as rollbacks and questions to them."""
    marks = rollbacks.select(key, F.col("at").alias("_place"), F.lit(0).alias("_kind"), F.struct("at", "to").alias("_back"), F.lit(None).cast(dict(asked.dtypes)["version"]).alias("version"))
    rows = marks.unionByName(asked.select(key, F.col("high").alias("_place"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<at:bigint,to:bigint>").alias("_back"), "version"))
    before = F.last("_back", ignorenulls=True).over(Window.partitionBy(key).orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("back", before).where("_kind = 1").select(key, "version", F.col("_place").alias("high"), "back")


def spans(asked: DataFrame, rollbacks: DataFrame, key: str = "question") -> DataFrame:
    """``key, version, low, high``: the stretches of the log that count at each asked version, ``low`` excluded and null at the log's start.

    ``asked`` has ``key, version, at``, ``rollbacks`` ``key, at, to``.  A rollback at a position returns to what counted at ``to``,
    which may itself have followed a rollback; what came between stays in the log and doesn't count.  One that isn't to an earlier
    position is none, and of several at one position the one furthest back holds.  Each round follows all versions one rollback
    further, so there are as many as rollbacks in a chain.  A null key is a key like others here.
    """
    back = rollbacks.select(key, F.col("at").cast("long").alias("at"), F.col("to").cast("long").alias("to")).where("to < at").groupBy(key, "at").agg(F.min("to").alias("to"))
    back = written(back, "rollbacks")
    open_, done = asked.select(key, "version", F.col("at").cast("long").alias("high")), None
    while True:
        found = written(_last_rollback(open_, back, key), "spans")
        part = found.select(key, "version", F.col("back.at").alias("low"), "high")
        done = part if done is None else done.unionByName(part)
        open_ = found.where("back is not null").select(key, "version", F.col("back.to").alias("high"))
        if open_.isEmpty():
            return done


def as_of(events: DataFrame, operations: DataFrame, spans_: DataFrame, key: str = "question") -> DataFrame:
    """The events active at each version: ``events`` (``key, event_id, at`` and more) with ``version``.

    An event is active if it lies in the version's spans and the last of its ``operations`` (``key, event_id, op, at``) there
    isn't ``retract``.  Events with a null key or position are in no version.  A hot key is dealt by event, spans copied to its parts.
    """
    spans_ = written(spans_, "spans")
    if spans_.count() <= BROADCAST_SPANS:
        few, on, dealt = F.broadcast(spans_), [key], lambda df: df
    else:
        few, on = spans_.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [key, "_part"]
        dealt = lambda df: df.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int"))
    inside: Column = (F.col("low").isNull() | (F.col("at") > F.col("low"))) & (F.col("at") <= F.col("high"))
    seen = lambda df: dealt(df).join(few, on).where(inside).drop("low", "high", "_part")
    last = seen(operations).groupBy(key, "version", "event_id").agg(F.max_by("op", "at").alias("_op"))
    return seen(events).join(last.where("_op = 'retract'"), [key, "version", "event_id"], "left_anti")
