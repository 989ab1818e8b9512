"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result to the shared folder and rereads it for the next one.
A document whose text loses lines has ``n_chars`` counted anew.  Rows are told apart by ``doc_id``; rows that share one share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import quality_model as grades
from assayer.llm.decontaminate import without_leaks
from assayer.llm.line_templates import drop_recurring
from assayer.llm.mixing import mixed_rows
from assayer.llm.neardup import near_duplicates
from assayer.llm.tables import written


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``keep``, a null id included."""
    ids = keep.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half, by a model fitted on the rated ones."""
    model = grades.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grades.rating_grade(), 3)
    return grades.select_documents(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur in independent ones."""
    return drop_recurring(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return _only(docs, near_duplicates(docs).where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, with ``shard``, in shuffled order within the shards."""
    return mixed_rows(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]
#: Fitted weights, signatures and edit distances can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
