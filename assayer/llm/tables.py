"""Shared plumbing: written tables in the shared folder, size-checked joins, hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

#: Up to so many rows of a narrow key table are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: A join key that more rows have is dealt over several tasks.
HOT_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: no folder is shared with the executors")
        folder = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/assayer/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (a written table of narrow rows) with a broadcast hint if it was counted to be within ``limit`` rows."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def met(rows: DataFrame, keys: DataFrame, on: str, spread: str, how: str = "inner", limit: int = BROADCAST_ROWS, most: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined (inner, left or left_semi) with ``keys``, a written table with one row for each value of ``on``.

    Up to ``limit`` keys are broadcast.  Beyond it the join shuffles, and a value that more than ``most`` rows have is dealt
    over several tasks by a hash of the column ``spread``, its row of ``keys`` copied to each.  A null value meets nothing.
    """
    if keys.count() <= limit:
        return rows.join(F.broadcast(keys), on, how)
    hot = rows.groupBy(on).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where(f"_parts > 1 and {on} is not null")
    hot = written(hot, "hot")  # at most one in `most` of the rows
    if hot.isEmpty():
        return rows.join(keys, on, how)
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(small(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = keys.join(small(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [on, "_part"], how).drop("_part")


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in UTF-8, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
