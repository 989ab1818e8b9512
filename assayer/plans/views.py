"""Views that the queries share: a decision log and a feedback log made of ``events``, labelled documents, JSON states.

``events`` carries no decisions of its own, so confidences, outcomes and sources are derived from the id: synthetic, but the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators.learners import TOLD

DEC = """dec AS (SELECT event_id AS seq, event_type AS question,
 CASE WHEN event_id % 10 < 7 THEN 'student' WHEN event_id % 10 < 9 THEN 'teacher' ELSE 'rule' END AS source,
 0.5::DOUBLE + ((event_id * 7919) % 1000) / 2000::DOUBLE AS conf,
 CASE WHEN 2 * ((event_id * 104729) % 1000) < 1000 + (event_id * 7919) % 1000 THEN 1 ELSE 0 END AS ok,
 event_id % 4 = 0 AS labelled, event_type || '/' || user_id % 3 AS label,
 event_type || '/' || CASE WHEN 2 * ((event_id * 104729) % 1000) < 1000 + (event_id * 7919) % 1000 THEN user_id % 3 ELSE (user_id + 1) % 3 END AS answer FROM events)"""
LOG = """log AS (SELECT event_id, 'action' AS question, event_type AS label, user_id % 6 AS annotator,
 CASE event_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'teacher' ELSE 'dataset' END AS source, event_id % 17 = 0 AS retracted, value FROM events)"""


#: A table of few files and so many bytes would be read by a task or two; it is dealt over the cores.
SMALL_BYTES = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df``, a table read from files, dealt over the cores if it is small; larger tables keep their splits."""
    context, files = df.sparkSession.sparkContext, df.inputFiles()
    if len(files) >= context.defaultParallelism:
        return df
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(context.defaultParallelism) if size <= SMALL_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in ("documents", "pages") else df  # texts are the work of a scan


def told(texts: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``texts`` that have labels, with these; up to TOLD labels are broadcast, so that no text is shuffled for them."""
    return texts.join(F.broadcast(labels) if labels.count() <= TOLD else labels, key)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, question, source, conf, ok, labelled, label, answer``; an answer is its label where ``ok``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("question"),
        F.expr("case when event_id % 10 < 7 then 'student' when event_id % 10 < 9 then 'teacher' else 'rule' end").alias("source"),
        F.expr("0.5D + ((event_id * 7919) % 1000) / 2000D").alias("conf"),
        F.expr("case when 2 * ((event_id * 104729) % 1000) < 1000 + (event_id * 7919) % 1000 then 1 else 0 end").alias("ok"),
        F.expr("event_id % 4 = 0").alias("labelled"),
        F.expr("event_type || '/' || user_id % 3").alias("label"),
        F.expr("event_type || '/' || case when 2 * ((event_id * 104729) % 1000) < 1000 + (event_id * 7919) % 1000 then user_id % 3 else (user_id + 1) % 3 end").alias("answer"),
    )


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, question, label, annotator, source, retracted, value``."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("action").alias("question"),
        F.col("event_type").alias("label"),
        F.expr("user_id % 6").alias("annotator"),
        F.expr("case event_id % 3 when 0 then 'human' when 1 then 'teacher' else 'dataset' end").alias("source"),
        F.expr("event_id % 17 = 0").alias("retracted"),
        "value",
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
