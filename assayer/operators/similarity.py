"""Similarity joins and votes: sparse features against labelled entries, earlier ones only if asked; dense vectors against all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import numbers as N, text as T
from assayer.operators.overlaps import feature_counts, joined, overlapping
from assayer.operators.running import running
from assayer.operators.tables import written

#: Entries a memory holds, neighbours, least similarity, candidates by overlap, share of smoothing.
CAPACITY, K, MIN_SIM, CANDIDATES, SMOOTH = 2000, 5, 0.35, 200, 0.1
#: States whose latest answers an exact match finds.
EXACT = 4 * CAPACITY
#: A log is ordered in blocks of so many places; queries of one state and block beyond so many are dealt over several tasks.
PLACES, HOT = 20_000, 200_000
#: Features of the entries that a task holds; queries of one block of a memory in a task, and tasks at most.
CHUNK, ASKED, MOST_TASKS = 16_000_000, 8_192, 20_000
#: Similarities of dense vectors that a task holds at once.
CELLS = 2_000_000


@dataclass(frozen=True)
class Search:
    """How neighbours are looked for: so many of at least a similarity, candidates by features that at most
    ``max(5, min(cap, entries / 4))`` entries have, exact states at similarity 1, only entries before the query."""

    k: int = K
    min_sim: float = MIN_SIM
    cap: int = CAPACITY
    exact: bool = False
    earlier: bool = True


def hashed(features: Column) -> Column:
    return F.transform(features, lambda f: F.xxhash64(f))


def with_vectors(rows: DataFrame, id_col: str, text_col: str, others: Column | None = None) -> DataFrame:
    """``id, seq, state, t, c`` and the columns of ``rows`` but the text: the hashed text features, which share one unit, and
    categories of weight 1 each (``others``, an array of names); ``state`` is the state's hash."""
    text = F.coalesce(text_col, F.lit(""))
    rows = rows.withColumn("_toks", T.tokens(text))  # a column of its own, else each use computes it anew
    columns = {"id": F.col(id_col).cast("long"), "seq": F.col(id_col).cast("long"), "state": T.state_hash(text), "t": hashed(T.token_features(F.col("_toks"))), "c": hashed(others) if others is not None else F.array().cast("array<bigint>")}
    return rows.withColumns(columns).drop(text_col, "_toks")


def with_texts(rows: DataFrame, id_col: str, text_col: str, others: Column | None = None) -> DataFrame:
    """As ``with_vectors``, but with ``words``, the text's tokens, in place of ``t``: a search deals these, a fraction of the features' bytes, and
    makes features where they arrive."""
    text = F.coalesce(text_col, F.lit(""))
    columns = {"id": F.col(id_col).cast("long"), "seq": F.col(id_col).cast("long"), "state": T.state_hash(text), "words": joined(text), "c": hashed(others) if others is not None else F.array().cast("array<bigint>")}
    return rows.withColumns(columns).drop(text_col)


def _features(rows: DataFrame) -> list[str]:
    """The columns that features are made of."""
    return ["words" if "words" in rows.columns else "t", "c"]


def _dealt(rows: DataFrame, group: Column, kind: int, place: Column) -> DataFrame:
    """Rows as ``overlapping`` takes them."""
    given = ["words", "c"] if "words" in rows.columns else [F.size("t").alias("texts"), F.concat("t", "c").alias("features")]
    return rows.select(group.cast("long").alias("group"), F.lit(kind).alias("kind"), "id", place.cast("long").alias("place"), *given)


def _ranked(found: DataFrame, search: Search) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "entry"))
    return found.where(F.col("sim") >= search.min_sim).withColumn("rank", rank).where(F.col("rank") <= search.k)


def neighbours(queries: DataFrame, entries: DataFrame, search: Search = Search()) -> DataFrame:
    """``id, entry, sim, rank``: the most similar entries of each query, ties to the older; both sides as ``with_vectors`` or ``with_texts`` gives them.

    Features that a quarter of the entries have find no candidates, but count in the similarity.  The ``CANDIDATES`` entries
    with most of the other features in common are compared.  Entries are cut by age in chunks of about CHUNK features, which a task
    holds as arrays; queries go to the chunks that hold entries before them, where their overlaps are counted, and only similar entries are
    given on, with how many others have each overlap: no pair is shuffled by its features.  What is dealt are the queries once for each chunk, and
    each chunk once for each of its tasks.  Frequent features, at most one in ``cap`` of all, are broadcast.
    """
    spark = queries.sparkSession
    e = entries.select("id", "seq", "state", *_features(entries))
    if "words" in e.columns:
        n, used = e.count(), feature_counts(e)
    else:
        e = written(e, "entries")
        n, used = e.count(), e.select(F.explode(F.concat("t", "c")).alias("f"), F.lit(1).alias("n"))
    used = used.groupBy("f").agg(F.sum("n").alias("n"))
    used = written(used.groupBy(F.when(F.col("n") > max(5, min(search.cap, n // 4)), F.col("f")).alias("f")).agg(F.sum("n").alias("n")), "used")  # the frequent ones, and all others as one
    size = used.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = np.array([r[0] for r in used.where("f is not null").select("f").collect()], np.int64)
    chunks = max(1, -(-size // CHUNK))
    cuts = sorted(set(e.approxQuantile("seq", [i / chunks for i in range(1, chunks)], 0.1 / chunks))) if chunks > 1 else []
    cuts = [int(c) for c in cuts]
    chunks = len(cuts) + 1
    tasks = max(1, -(-2 * spark.sparkContext.defaultParallelism // chunks))

    of = lambda x: sum((F.when(x > c, 1).otherwise(0) for c in cuts), F.lit(0))
    held = _dealt(e.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))), of(F.col("seq")) * tasks + F.col("_t"), 0, F.col("seq"))
    last = of(F.col("seq") - 1) if search.earlier else F.lit(chunks - 1)  # chunks of older entries, and the one it lies in
    asked = queries.select("id", "seq", *_features(queries), F.explode(F.sequence(F.lit(0), last)).alias("_c"))
    asked = _dealt(asked, F.col("_c") * tasks + F.pmod(F.xxhash64("id"), F.lit(tasks)), 1, F.col("seq") if search.earlier else F.lit(2**62))
    found = overlapping(held.union(asked), chunks * tasks, CANDIDATES, search.min_sim, search.cap, frequent=frequent, k=search.k if chunks == 1 else None)
    each = F.arrays_zip(F.col("entries").alias("entry"), F.col("sims").alias("sim"), F.col("overlaps").alias("o"), F.col("ranks").alias("r"))
    if chunks > 1:
        # an entry is among CANDIDATES if fewer than that, of all chunks, have a greater overlap, or as great a one and are older
        found = found.withColumn("c", F.floor(F.col("group") / tasks)).select("id", F.struct("c", each.alias("near"), F.arrays_zip("levels", "counts").alias("all")).alias("x"))
        found = found.groupBy("id").agg(F.collect_list("x").alias("x")).where(F.exists("x", lambda x: F.size(x["near"]) > 0))
        found = found.select("id", "x", F.explode("x").alias("y")).select("id", "x", F.col("y.c").alias("c"), F.explode("y.near").alias("y"))
        ahead = lambda l, c: (l["levels"] > F.col("y.o")) | ((l["levels"] == F.col("y.o")) & (c < F.col("c")))
        of_chunk = lambda x: F.aggregate(F.filter(x["all"], lambda l: ahead(l, x["c"])), F.lit(0).cast("long"), lambda a, l: a + l["counts"])
        others = F.aggregate(F.filter("x", lambda x: x["c"] != F.col("c")), F.lit(0).cast("long"), lambda a, x: a + of_chunk(x))
        found = found.where(F.col("y.r") + others < CANDIDATES).select("id", "y.entry", "y.sim")
    else:
        found = found.select("id", F.explode(each).alias("x")).select("id", "x.entry", "x.sim")
    if search.exact:
        # of equal states the k oldest come first for every query: the others are never among its best (seq has the order of id)
        old = e.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy("id"))).where(F.col("_r") <= search.k).select(F.col("id").alias("entry"), F.col("seq").alias("eseq"), "state")
        same = queries.select("id", "seq", "state").join(old, "state").where(F.col("eseq") < F.col("seq") if search.earlier else F.lit(True)).select("id", "entry", F.lit(1.0).alias("sim"))
        found = found.union(same).groupBy("id", "entry").agg(F.max("sim").alias("sim"))
    return written(_ranked(found, search), "neighbours")


def votes(near: DataFrame, weights: DataFrame, options: list[str], smooth: float, power: int = 2) -> DataFrame:
    """``id, near, best_sim, probs`` in option order: sim^power times the entry's weight, summed by label, normalised, smoothed.

    ``weights`` has ``entry, label, weight``; a query whose neighbours have no weight for any option has no row.
    """
    rows = near.join(weights, "entry")
    share = lambda o: F.sum(F.when(F.col("label") == o, F.pow("sim", F.lit(power)) * F.col("weight")).otherwise(0.0))
    out = rows.groupBy("id").agg(F.count("*").alias("near"), F.max("sim").alias("best_sim"), F.array(*map(share, options)).alias("v"))
    return out.where(N.total(F.col("v")) > 0).select("id", "near", "best_sim", N.smoothed(N.normalized(F.col("v")), smooth).alias("probs"))


def placed(queries: DataFrame, entries: DataFrame, sums: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``id, known`` of the queries, the number of entries before each, and ``entry, place`` of the entries, from 1 in log order.

    ``sums`` are columns of the entries (numbers) whose totals before it each query also gets.  Both are counted by blocks of the log.
    """
    sums = sums or {}
    asked = queries.select("id", "seq", F.lit(0).alias("_kind"), *(F.lit(0.0).alias(k) for k in sums))
    given = entries.select("id", "seq", F.lit(1).alias("_kind"), *(v.cast("double").alias(k) for k, v in sums.items()))
    run = running(asked.union(given), [], F.floor(F.col("seq") / PLACES), [F.asc("seq"), F.asc("_kind")], {"known": F.col("_kind"), **{k: F.col(k) for k in sums}})
    return run.where("_kind = 0").select("id", "known", *sums), run.where("_kind = 1").select(F.col("id").alias("entry"), F.col("known").alias("place"))


def neighbours_as_of(queries: DataFrame, entries: DataFrame, capacity: int = CAPACITY, search: Search = Search()) -> DataFrame:
    """``id, entry, sim, rank``: the most similar entries of a memory as it was when each query came: the ``capacity`` newest before it.

    Both sides as ``with_vectors`` or ``with_texts`` gives them, ids without repeats.  Features that more than a quarter of that memory has find no candidates
    but count in the similarity; the ``CANDIDATES`` entries with most of the other features in common are compared, ties to the older.

    The log is cut in blocks of ``capacity`` entries.  A query's memory lies in the block of its newest entry and the block before, which a task
    holds as arrays, at most twice the capacity, while the block's queries stream past it; more than ASKED queries of a block are dealt
    over several tasks, each with those entries.  Nothing is joined by feature: an entry is dealt twice for each task, a query once.
    """
    known, places = placed(queries, entries)
    small = lambda df: df.hint("shuffle_hash")  # places are small, so texts need no order to meet them
    held = entries.select("id", *_features(entries)).join(small(places.withColumnRenamed("entry", "id")), "id")
    asked = queries.select("id", *_features(queries)).join(small(known.where("known > 0")), "id").withColumn("block", F.floor((F.col("known") - 1) / capacity))
    blocks = known.where("known > 0").groupBy(F.floor((F.col("known") - 1) / capacity).alias("block")).agg(F.ceil(F.count("*") / ASKED).alias("n"))
    blocks = written(blocks.withColumn("begin", F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))), "blocks")  # one row for `capacity` entries
    blocks, tasks = F.broadcast(blocks.na.fill(0, ["begin"])), blocks.agg(F.sum("n")).first()[0] or 1
    block = F.floor((F.col("place") - 1) / capacity)
    held = held.withColumn("block", F.explode(F.array(block, block + 1))).join(blocks, "block").withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    asked = asked.join(blocks, "block")
    rows = _dealt(held, F.col("begin") + F.col("_t"), 0, F.col("place")).union(_dealt(asked, F.col("begin") + F.pmod(F.xxhash64("id"), "n"), 1, F.col("known") + 1))
    found = overlapping(rows, min(tasks, MOST_TASKS), CANDIDATES, search.min_sim, search.cap, capacity, k=search.k)
    found = found.select("id", F.explode(F.arrays_zip(F.col("entries").alias("entry"), F.col("sims").alias("sim"))).alias("x")).select("id", "x.entry", "x.sim")
    return _ranked(found, search)


def exact_answers(queries: DataFrame, labelled: DataFrame, options: list[str], capacity: int = EXACT) -> DataFrame:
    """``id, exact``: the smoothed answer of the newest of the weightiest labels of the very same state, among the ``capacity`` newest before each query.

    ``labelled`` has ``id, seq, state, label, weight``.  In blocks of ``capacity`` labels, what a query may see is the end of one block and the
    beginning of the next: a running best from either side.  A task orders one state's rows of one block; where very many queries share
    a state they are dealt over tasks, each with that state's labels of the block.
    """
    known, places = placed(queries, labelled)
    asked = queries.select("id", "state").join(known.where("known > 0"), "id")
    at, to = F.floor((F.col("known") - 1) / capacity), F.col("known")
    asked = asked.select("id", "state", F.explode(F.array(*(F.struct(b.alias("block"), F.lit(way).alias("way"), o.alias("o")) for b, way, o in ((at, 0, 2 * to + 1), (at - 1, 1, 2 * (capacity - to) - 1))))).alias("x")).select("id", "state", "x.*")
    said = labelled.join(places.withColumnRenamed("entry", "id"), "id").select("state", F.floor((F.col("place") - 1) / capacity).alias("block"), F.struct("weight", "place", "label").alias("best"))
    said = said.select("state", "block", "best", F.explode(F.array(*(F.struct(F.lit(way).alias("way"), (2 * sign * F.col("best.place")).alias("o")) for way, sign in ((0, 1), (1, -1))))).alias("x")).select("state", "block", "best", "x.*")
    keys = ["state", "block", "way"]
    asked = asked.join(said.select(*keys).distinct(), keys, "left_semi")
    parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / HOT).cast("int").alias("_n")).where("_n > 1")
    n = F.coalesce("_n", F.lit(1))
    asked = asked.join(parts, keys, "left").select("id", *keys, "o", F.pmod(F.xxhash64("id"), n).cast("int").alias("part"), F.lit(None).cast(said.schema["best"].dataType).alias("best"))
    said = said.join(parts, keys, "left").select(F.lit(None).cast("long").alias("id"), *keys, "o", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), "best")
    so_far = F.max("best").over(Window.partitionBy(*keys, "part").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    best = asked.union(said).withColumn("_b", so_far).where("id is not null").groupBy("id").agg(F.max("_b")["label"].alias("label")).where("label is not null")
    one = F.array(*(F.when(F.col("label") == o, 1.0).otherwise(0.0) for o in options))
    return best.select("id", N.smoothed(one, SMOOTH).alias("exact"))


def memory_vote(queries: DataFrame, labelled: DataFrame, options: list[str]) -> DataFrame:
    """``id, near, best_sim, exact, probs``: the answer of the same state if one is known, else the vote of similar earlier ones.

    Both sides as ``with_vectors`` or ``with_texts`` gives them, ``labelled`` with ``label`` and ``weight``; a query meets the memory as it was when the query came:
    the newest CAPACITY labels before it, and the newest EXACT for the same state.  ``probs`` is null where nothing is known.
    """
    known = labelled.where("label is not null")
    vote = votes(neighbours_as_of(queries, known, CAPACITY), known.select(F.col("id").alias("entry"), "label", "weight"), options, SMOOTH)
    out = queries.select("id").join(vote, "id", "left").join(exact_answers(queries, known, options, EXACT), "id", "left")
    return out.select("id", F.coalesce("near", F.lit(0)).alias("near"), "best_sim", F.col("exact").isNotNull().alias("exact"), F.coalesce("exact", "probs").alias("probs"))


def counts_before(queries: DataFrame, labelled: DataFrame, options: list[str]) -> DataFrame:
    """``id, counts``: how many earlier labels each option has, in option order."""
    names = [f"_c{i}" for i in range(len(options))]
    known = placed(queries, labelled.where("label is not null"), {n: (F.col("label") == o).cast("int") for n, o in zip(names, options)})[0]
    return known.select("id", F.array(*names).alias("counts"))


def vector_neighbours(queries: DataFrame, vectors: DataFrame, k: int = K, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query, vec_id, sim, rank``: the k most similar vectors of each query, by cosine, itself left out.

    Queries go in blocks of bounded size, each broadcast; every partition of the vectors gives its own best k for each
    query, and a grouped top-k joins them: k rows a query and partition are shuffled, whatever the table's size.
    """
    spark, best = queries.sparkSession, None
    blocks = -(-queries.count() // block)
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)
        rows = some.select(id_col, vec_col).where(f"{vec_col} is not null").collect()
        q = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for rows in batches:
                rows = rows[rows[vec_col].notna()]
                if not len(rows) or not len(names):
                    continue
                x = np.stack(rows[vec_col].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                own = rows[id_col].to_numpy()
                step = max(1, CELLS // len(own))
                for a in range(0, len(names), step):  # so many similarities at once, however many queries and rows there are
                    some = names[a : a + step]
                    sim = np.round(q[a : a + step] @ x.T, 9)
                    sim[some[:, None] == own[None, :]] = -2
                    if sim.shape[1] > k:  # ties with the k-th are kept, and the order is made of those only
                        least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
                        near = [np.flatnonzero(s >= t) for s, t in zip(sim, least)]
                    else:
                        near = [np.arange(sim.shape[1])] * len(sim)
                    top = [n[np.lexsort((own[n], -s[n]))[:k]] for n, s in zip(near, sim)]
                    at, to = np.repeat(np.arange(len(top)), [len(t) for t in top]), np.concatenate(top)
                    yield pd.DataFrame({"query": some[at], id_col: own[to], "sim": sim[at, to]}).query("sim > -2")

        part = vectors.select(id_col, vec_col).mapInPandas(run, f"query long, {id_col} long, sim double")
        best = part if best is None else best.union(part)
    if best is None:
        return vectors.select(F.col(id_col).alias("query"), id_col, F.lit(0.0).alias("sim"), F.lit(0).alias("rank")).limit(0)
    top = best.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col(id_col)))), 1, k).alias("t"))
    return top.select("query", F.posexplode("t").alias("p", "x")).select("query", F.col(f"x.{id_col}"), (-F.col("x.d")).alias("sim"), (F.col("p") + 1).alias("rank"))
