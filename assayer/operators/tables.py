"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: no folder is shared with the executors")
        folder = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back: made once, no executor holds it, it survives lost ones.

    With ``partition``, a column of few values, a filter on it reads its rows only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/assayer/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def bucketed(spark: SparkSession, key: str, buckets: int) -> Iterator[Callable[..., DataFrame]]:
    """A ``written`` for tables in so many buckets of ``key``, which meet and are summed by it without a shuffle.

    Rows are not dealt by it: the caller does that where they do not lie so yet.  Files are in the shared folder; the catalog's entries, and the
    frames given, last as long as the block.
    """
    names: list[str] = []

    def write(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        names.append(f"assayer_{name}_{uuid.uuid4().hex}")
        rows = df.write.format("parquet").option("path", f"{shared_folder(spark).rstrip('/')}/assayer/{names[-1]}").bucketBy(buckets, key)
        (rows.partitionBy(partition) if partition else rows).saveAsTable(names[-1])
        return spark.table(names[-1]).select(*df.columns)

    try:
        yield write
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
