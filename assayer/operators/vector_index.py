"""An inverted file for dense vectors: centres fitted on a bounded sample, every row dealt to its centre's list, exact ranking of the lists probed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from assayer.operators.similarity import K, vector_neighbours
from assayer.operators.tables import written

#: Lists at most, sampled rows for each list, rounds of fitting: the sample is within MOST_LISTS * SAMPLED rows.
MOST_LISTS, SAMPLED, ROUNDS = 2048, 40, 8
#: A list of more rows falls into parts of about so many, its queries into blocks of about so many.
LIST_ROWS, LIST_QUERIES = 20_000, 4096
#: Rows whose exact neighbours tell how many lists to probe.
TRIED = 256


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (id, vector, ``list``), a written table, and the centre of each list."""

    centres: np.ndarray
    rows: DataFrame
    id_col: str
    vec_col: str


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by cosine: the first ``lists`` rows, then means of what is nearest; an empty one stays where it was."""
    centres = x[:lists].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        some = np.bincount(nearest, minlength=len(centres)) > 0
        centres[some] = unit(sums[some])
    return centres


def _stacked(rows: pd.DataFrame, column: str) -> np.ndarray:
    return unit(np.stack(rows[column].to_numpy()).astype(float))


def _known(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col)).where(f"{id_col} is not null and {vec_col} is not null")


def vector_index(vectors: DataFrame, lists: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """An index of every row with an id and a vector; ``lists`` is the root of their number unless given, MOST_LISTS at most.

    Centres are fitted on the ``lists * SAMPLED`` rows of least hash, so reruns agree; all rows are dealt by them.
    Ids are taken as unique; rows without an id or a vector have no neighbours.  An empty table gives an index without lists.
    """
    rows = _known(vectors, id_col, vec_col)
    lists = min(MOST_LISTS, lists or int(np.ceil(np.sqrt(rows.count()))))
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(lists * SAMPLED).collect()
    centres = fitted(unit(np.array([r[1] for r in sample], float)), lists) if sample else np.zeros((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # MOST_LISTS centres at most

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part) and len(shared.value):
                yield part.assign(list=np.argmax(_stacked(part, vec_col) @ shared.value.T, axis=1).astype("int32"))

    dealt = rows.mapInPandas(deal, f"{id_col} long, {vec_col} array<double>, list int")
    return VectorIndex(centres, written(dealt, "vectors"), id_col, vec_col)


def probes_for(index: VectorIndex, recall: float = 0.95, k: int = K, tried: int = TRIED) -> int:
    """The fewest probes that find a share ``recall`` of the exact neighbours of ``tried`` rows, those of least hash.

    Vectors without clusters need many of the lists, clustered ones few; this is measured against all rows, by one exact search
    for a bounded number of queries.
    """
    id_col, vec_col, rows = index.id_col, index.vec_col, index.rows
    some = rows.select(id_col, vec_col).orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(tried).collect()
    if not some:
        return 1
    some_df = rows.sparkSession.createDataFrame(some, f"{id_col} long, {vec_col} array<double>")
    exact = vector_neighbours(some_df, rows, k, id_col=id_col, vec_col=vec_col).select("query", F.col(id_col).alias("_id"))
    lists = rows.select(F.col(id_col).alias("_id"), "list").join(F.broadcast(exact), "_id").select("query", "list").collect()  # tried * k rows
    places = np.argsort(np.argsort(-(unit(np.array([r[1] for r in some], float)) @ index.centres.T), axis=1, kind="stable"), axis=1)
    place = {r[0]: p for r, p in zip(some, places)}
    needed = np.sort([place[r["query"]][r["list"]] + 1 for r in lists])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1


def index_neighbours(queries: DataFrame, index: VectorIndex, k: int = K, probes: int = 8) -> DataFrame:
    """``query, vec_id, sim, rank``: the k most similar of the rows in the ``probes`` lists whose centres are nearest to a query, itself left out.

    Ranks are exact among those rows; with as many probes as lists the result is that of ``vector_neighbours``.  A query meets its
    lists by a shuffle on the list; a large list is dealt in parts and its queries in blocks, so no task holds a list,
    and each part gives k rows a query.
    """
    id_col, vec_col = index.id_col, index.vec_col
    schema = f"query long, {id_col} long, sim double"
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part) and len(shared.value):
                near = np.argsort(-(_stacked(part, vec_col) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query": part[id_col].repeat(near.shape[1]), "vector": part[vec_col].repeat(near.shape[1]), "list": near.ravel().astype("int32")})

    asked = written(_known(queries, id_col, vec_col).mapInPandas(probe, "query long, vector array<double>, list int"), "probes")
    sizes = index.rows.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    asks = asked.groupBy("list").agg(F.ceil(F.count("*") / LIST_QUERIES).cast("int").alias("blocks"))
    deals = F.broadcast(written(sizes.join(asks, "list"), "deals"))  # MOST_LISTS rows at most
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(deals, "list").withColumn("part", F.pmod(F.xxhash64(id_col), "parts").cast("int")).withColumn("block", numbers("blocks"))
    asked = asked.join(deals, "list").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).withColumn("part", numbers("parts"))
    on = ["list", "part", "block"]

    def rank(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query": [], id_col: [], "sim": []}).astype({"query": "int64", id_col: "int64"})
        own, names, x, found = rows[id_col].to_numpy(), asked["query"].to_numpy(), _stacked(rows, vec_col), []
        for i in range(0, len(asked), 256):
            sim = np.round(_stacked(asked.iloc[i : i + 256], "vector") @ x.T, 9)
            sim[names[i : i + 256, None] == own[None, :]] = -2
            top = np.stack([np.lexsort((own, -s))[:k] for s in sim])
            found.append(pd.DataFrame({"query": names[i : i + 256].repeat(top.shape[1]), id_col: own[top].ravel(), "sim": np.take_along_axis(sim, top, axis=1).ravel()}))
        return pd.concat(found).query("sim > -2")

    pairs = asked.select("query", "vector", *on).groupBy(*on).cogroup(rows.select(id_col, vec_col, *on).groupBy(*on)).applyInPandas(rank, schema)
    top = pairs.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col(id_col)))), 1, k).alias("t"))  # k rows a part probed
    return top.select("query", F.posexplode("t").alias("p", "x")).select("query", F.col(f"x.{id_col}").alias(id_col), (-F.col("x.d")).alias("sim"), (F.col("p") + 1).alias("rank"))
