"""Dataset files: delimited text with a sniffed separator, JSON arrays, wrapped rows and JSON lines, as cleaned DataFrames."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions.text import to_number

#: Fixed values.
SEPARATORS, SNIFFED, MAX_ROWS = (",", ";", "\t", "|"), 20_000, 200_000
REGISTRY = "id string, name string, source string, columns array<string>, deleted boolean"
WRAPPERS = ("rows", "data", "records", "items")


def sniff_separator(head: str) -> str:
    """The separator that splits the first lines into most fields, as many in each; a comma if none does."""
    lines = [x for x in head[:SNIFFED].splitlines() if x.strip()][:20]
    fields = {s: [x.count(s) for x in lines] for s in SEPARATORS}
    even = [s for s in SEPARATORS if lines and min(fields[s]) > 0]
    return max(even, key=lambda s: (min(fields[s]), fields[s].count(fields[s][0])), default=",")


def cleaned(df: DataFrame) -> DataFrame:
    """Without unnamed columns and empty rows; text stripped, header names too."""
    named = df.select(*(F.col(f"`{c}`").alias(c.strip()) for c in df.columns if c and c.strip()))
    out = named.select(*(F.trim(c).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in named.dtypes))
    full = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "" for c, kind in out.dtypes if not kind.startswith(("array", "struct", "map"))]
    return out.where(reduce(lambda a, b: a | b, full)) if full else out


def head(spark: SparkSession, path: str) -> str:
    """The first SNIFFED characters of a file, of a folder's first file by name; bytes that aren't UTF-8 become U+FFFD."""
    rows = spark.read.text(path)
    lines = spark.read.text(sorted(rows.inputFiles())[0]).limit(1000).collect()  # a limit takes the file's beginning
    return "\n".join(r[0] for r in lines)[:SNIFFED]


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, most: int | None = None) -> DataFrame:
    """A delimited file or folder with a header, in UTF-8 (with or without its mark) or, if any line isn't, in Latin-1.

    The encoding is decided by a scan of all lines, the separator sniffed from the beginning; ``most`` (a usual limit is MAX_ROWS) takes so many rows only.
    """
    start = head(spark, path)
    valid = spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    encoding = "UTF-8" if valid else "ISO-8859-1"
    separator = sniff_separator(start.lstrip("\ufeff")) if separator is None else separator
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("encoding", encoding).csv(path)
    df = cleaned(df.toDF(*(c.lstrip("\ufeff") for c in df.columns)))
    return df.limit(most) if most else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, an array of objects, or an object that holds its rows under one of WRAPPERS."""
    first = next((r[0].lstrip("﻿ \t") for r in spark.read.text(path).where("length(trim(value)) > 0").limit(1).collect()), "")
    lines = first.startswith("{") and first.rstrip().endswith("}")
    df = spark.read.option("multiLine", not lines).json(path)
    for name in WRAPPERS:
        kind = df.schema[name].dataType if name in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return cleaned(df.select(F.explode(name).alias("_r")).select("_r.*"))
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{path} has rows that aren't objects")
    return cleaned(df)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending: csv, tsv, txt, json, jsonl, ndjson, parquet or orc."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    return read_json(spark, path) if kind in ("json", "jsonl", "ndjson") else read_delimited(spark, path)


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns in the order first seen, null where a frame lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def profile(df: DataFrame, values: int = 12) -> DataFrame:
    """``column, n, missing, distinct, kind, values`` in one pass: object for nested columns, number if all values read as one (a
    comma is a decimal point), text if over 40 characters on average, else category; ``values`` are the first so many in order,
    of categories and numbers.  Blank values are missing."""
    parts, kinds = [], dict(df.dtypes)
    nested = {c for c, kind in kinds.items() if kind.startswith(("array", "struct", "map"))}
    for c in kinds:
        text = F.to_json(F.col(f"`{c}`")) if c in nested else F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
        parts += [F.count(text).alias(f"n {c}"), F.count_distinct(text).alias(f"d {c}"), F.count(to_number(text)).alias(f"x {c}"), F.avg(F.length(text)).alias(f"l {c}")]
    one = df.agg(F.count("*").alias("all"), *parts)
    g = lambda k, c: F.col(f"`{k} {c}`")
    kind = lambda c: F.lit("object") if c in nested else F.when((g("n", c) > 0) & (g("x", c) == g("n", c)), "number").when(g("l", c) > 40, "text").otherwise("category")
    rows = [F.struct(F.lit(c).alias("column"), g("n", c).alias("n"), (F.col("all") - g("n", c)).alias("missing"), g("d", c).alias("distinct"), kind(c).alias("kind")) for c in kinds]
    found = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return found.join(first_values(df.select(*(F.col(f"`{c}`") for c in kinds if c not in nested)), values), "column", "left").withColumn("values", F.when(F.col("kind").isin("category", "number"), F.col("values")).otherwise(F.array().cast("array<string>")))


def first_values(df: DataFrame, most: int) -> DataFrame:
    """``column, values``: the least ``most`` different values of each column; distinct values meet, never rows."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in df.columns))).alias("x")).select("x.*").where("v is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("v"))  # Spark keeps `most` of a column before the shuffle
    return long.withColumn("r", rank).where(F.col("r") <= most).groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("values"))


def create_dataset(df: DataFrame, folder: str, name: str, source: str = "upload") -> str:
    """Write rows, numbered in their order, under ``folder`` and append them to its registry; the dataset's id."""
    key = uuid.uuid4().hex[:12]
    rows = df.withColumn("idx", F.monotonically_increasing_id())
    rows.write.parquet(f"{folder}/rows/{key}")
    entry = [(key, name, source, list(df.columns), False)]
    df.sparkSession.createDataFrame(entry, REGISTRY).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/registry")
    return key


def delete_dataset(spark: SparkSession, folder: str, key: str) -> None:
    """Append a deletion: the registry's view leaves the dataset out; its files go when the folder is swept."""
    spark.createDataFrame([(key, None, None, None, True)], REGISTRY).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/registry")


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """``id, name, source, columns, at`` of the datasets that weren't deleted, newest first."""
    log = spark.read.parquet(f"{folder}/registry")
    return log.where("not deleted").join(log.where("deleted").select("id"), "id", "left_anti").drop("deleted").orderBy(F.desc("at"))


def dataset_rows(spark: SparkSession, folder: str, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A dataset's rows in order."""
    rows = spark.read.parquet(f"{folder}/rows/{key}").orderBy("idx").offset(offset)
    return (rows.limit(limit) if limit else rows).drop("idx")
