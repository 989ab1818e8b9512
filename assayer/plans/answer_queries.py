"""Queries of typed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.answers import Question
from assayer.plans.registry import query
from assayer.plans.views import table

PRIORITY = Question("priority", "score", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'HAYIR' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' END AS raw FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 2 THEN 'true' WHEN 1 THEN CASE WHEN lower(raw) IN ('hayır', 'hayir') THEN 'false' END END AS label FROM r""")
def noul_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case event_id % 5 when 0 then ' Yes ' when 1 then 'HAYIR' when 2 then '1' when 3 then 'maybe' end")
    return table(spark, d, "events").select("event_id", Question("sure", "noul").label(raw).alias("label"))


@query("""WITH p AS (SELECT event_id, event_id % 7 AS a, event_id % 3 AS b, greatest(0, event_id % 5 - 2) AS c FROM events), s AS (SELECT *, (a + b + c)::DOUBLE AS t FROM p)
SELECT event_id, CASE WHEN t > 0 THEN round((a / t + 0.01 / 3) / 1.01, 6) END AS a, CASE WHEN t > 0 THEN round((c / t + 0.01 / 3) / 1.01, 6) END AS c FROM s""")
def teacher_distribution(spark: SparkSession, d: str) -> DataFrame:
    q = Question("team", "choice", ("a", "b", "c"))
    stated = F.expr("map('a', cast(event_id % 7 as double), 'b', cast(event_id % 3 as double), 'c', cast(event_id % 5 - 2 as double), 'other', 9D)")
    return table(spark, d, "events").select("event_id", q.teacher(stated).alias("p")).select("event_id", F.round(F.get("p", 0), 6).alias("a"), F.round(F.get("p", 2), 6).alias("c"))


@query("""WITH o AS (SELECT o_orderkey, left(o_orderpriority, 1)::INT AS y, o_orderpriority AS answer FROM orders)
SELECT o_orderkey, answer, 0.6::DOUBLE AS confidence, round(((y - 1) * 0.6 + 0.1 * (10 - (y - 1)))::DOUBLE, 4) AS score FROM o""")
def score_answers(spark: SparkSession, d: str) -> DataFrame:
    """The level that an order's priority names, with 0.6 on it and the rest spread evenly."""
    probs = F.transform(F.array(*map(F.lit, PRIORITY.options)), lambda o: F.when(o == F.col("l"), 0.6).otherwise(0.1))
    rows = table(spark, d, "orders").select("o_orderkey", PRIORITY.label(F.lower("o_orderpriority")).alias("l"))
    return rows.select("o_orderkey", PRIORITY.public(probs).alias("x")).select("o_orderkey", "x.answer", "x.confidence", "x.score")
