"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from assayer.llm.components import connected_components
from assayer.llm.tables import dropped, hashed, met, mixed, small, words, written

#: Rows and bytes of shingles of one block of a group whose members are compared with one another.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of the whole sequence if it has fewer words; empty without words."""
    h = hashed(words(text))
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mixed(out + h[i : len(h) - size + 1 + i] + np.uint64(i + 1))
    return np.unique(out)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, size=(2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least upper half of ``h * a + b`` over a set, for each pair (a, b)."""
    least = np.full(factors.shape[1], 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * factors[0] + factors[1]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fewest_matches(n: int, percent: int, miss: float) -> int:
    """The fewest of ``n`` equal signature values at which P(similarity >= percent/100) is at least ``miss``.

    Under a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its upper tail at t is the
    probability that Binomial(n + 1, t) is at most m.
    """
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


class Verifier:
    """Compares signatures batch by batch, gives up on pairs whose posterior falls under the miss probability, and confirms the rest exactly."""

    def __init__(self, hashes: int, percent: int, miss: float, batch: int = 32) -> None:
        self.percent = percent
        self.steps = [(n, min(n + batch, hashes), fewest_matches(min(n + batch, hashes), percent, miss)) for n in range(0, hashes, batch)]

    def survivors(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indexes of the rows of ``right`` that ``left`` (one row, or as many) may be similar to."""
        alive = np.arange(len(right))
        matches = np.zeros(len(right), dtype=np.int64)
        one = left.ndim == 1
        for a, b, least in self.steps:
            own = left[a:b] if one else left[alive, a:b]
            matches = matches + (right[alive, a:b] == own).sum(axis=1)
            held = matches >= least
            alive, matches = alive[held], matches[held]
            if not len(alive):
                break
        return alive

    def linked(self, common: int | np.ndarray, n: int, m: int | np.ndarray) -> bool | np.ndarray:
        return 100 * common >= self.percent * (n + m - common)


def _features(size: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(hashes)
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text, size)
                n.append(len(grams))
                key.append(xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sig.append(signature(grams, factors).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "key", "sig"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(text, size).tobytes() for text in batch.column(1).to_pylist()], pa.binary())], ["id", "grams"])

    return run


def _survivors(verifier: Verifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.array([np.frombuffer(s, np.uint32) for s in batch.column(c).to_pylist()], dtype=np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b")]
            good = verifier.survivors(*sigs) if batch.num_rows else []
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _confirm_pairs(verifier: Verifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("grams_a", "grams_b"))
                if verifier.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _confirm_blocks(verifier: Verifier):
    """Edges that join different components among the rows of one or two blocks; as many as components less one at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        ids, blocks = rows["rep"].to_numpy(), rows["block"].to_numpy()
        comp = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        sigs = np.array([np.frombuffer(s, np.uint32) for s in rows["sig"]])
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        sizes = np.array([len(s) for s in sets])
        gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(sizes)])
        across = blocks.min() != blocks.max()
        found = []
        for i in range(len(ids)):
            rest = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((blocks[i + 1 :] != blocks[i]) | (not across))) + i + 1
            rest = rest[verifier.survivors(sigs[i], sigs[rest])] if len(rest) else rest
            if not len(rest):
                continue
            own = np.zeros(len(gram) and gram.max() + 1, dtype=bool)
            own[gram[at[i] : at[i + 1]]] = True
            for j in rest:
                if comp[j] != comp[i] and verifier.linked(int(own[gram[at[j] : at[j + 1]]].sum()), sizes[i], sizes[j]):
                    found.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _side(table: DataFrame, key: str, what: str, side: str) -> tuple[DataFrame, str]:
    return table.select(F.col(key).alias(side), F.col(what).alias(f"{what}_{side}")), side


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 5, bands: int = 32, miss: float = 1e-6) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.

    1. Equal sets form a class, named by its least id, so exact copies never meet one another again.
    2. MinHash signatures (``rows * bands`` values) are cut into bands; each bucket links its members to its least
       member only (a star), so a bucket of any size gives as many pairs as members.
    3. A pair's signatures are compared 32 values at a time; it is dropped once the posterior probability of a
       similar pair is under ``miss``, and what survives is confirmed on the full sets, which only then are made.  A pair at the threshold
       shares no band with probability (1 - t^rows)^bands: 7e-9 at 0.85, 3e-6 at 0.8.
    4. A bucket whose members are still in different components is compared in full, in blocks of bounded rows and
       bytes, again by signature batches and exact sets; of buckets with the same members one is.  A block returns joining
       edges only, never pairs within a component, so no link between components is lost and the output stays within the
       number of members.
    5. Components by repeated grouped minima.

    Null, empty and blank texts have no set: ``n_shingles`` 0, their own component, kept.  Rows that share an id are one
    vertex; identical rows give identical results.  A null id takes part in a class but names no component: if no row of the class
    has an id, ``component_id`` is null and ``kept`` true.  Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashes = rows * bands
    verifier = Verifier(hashes, percent, miss)
    feats = written(narrow.mapInArrow(_features(size, hashes), "id long, n long, key binary, sig binary"), "signatures")
    classes = feats.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"))
    # by key and id, so that the copies of one text are no hot key
    reps = written(feats.join(classes.withColumnRenamed("rep", "id"), ["key", "id"]).select(F.col("id").alias("rep"), "sig", "n").distinct(), "reps")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.substring("sig", i * (4 * rows) + 1, F.lit(4 * rows)), i))
    buckets = reps.select("rep", F.explode(keys).alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("members")).where("hub <> top")
    star = written(buckets.join(hubs, "bucket").where("rep <> hub").select("bucket", "rep", "hub", (F.col("members") > 2).alias("many")), "stars")

    ids = written(star.select("rep").union(star.select("hub")).distinct(), "candidates")
    sigs = written(reps.join(small(ids), "rep", "left_semi"), "candidate-signatures")
    both = lambda pairs, table, key, what: met(met(pairs, *_side(table, key, what, "a"), "b", limit=0), *_side(table, key, what, "b"), "a", limit=0)
    pairs = star.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    alike = written(both(pairs, sigs, "rep", "sig").mapInArrow(_survivors(verifier), "a long, b long"), "alike")
    known = written(alike.select(F.col("a").alias("id")).union(alike.select("b")).distinct(), "known")
    sets = written(narrow.join(small(known), "id", "left_semi").mapInArrow(_sets(size), "id long, grams binary"), "sets")
    edges = written(both(alike, sets, "id", "grams").mapInArrow(_confirm_pairs(verifier), "a long, b long"), "links")
    first = connected_components(edges, "a", "b")

    of = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"{c}_comp"))
    many = star.where("many").join(of("rep"), "rep", "left")
    many = written(met(many, written(of("hub"), "comps"), "hub", "rep", "left").select("bucket", "rep", "hub", F.coalesce("rep_comp", "rep").alias("comp"), F.coalesce("hub_comp", "hub").alias("hub_comp")), "many")
    members = many.select("bucket", "rep", "comp").union(many.select("bucket", F.col("hub").alias("rep"), F.col("hub_comp").alias("comp")).distinct())
    split = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).where("low <> high")
    split = written(split.groupBy("c", "who").agg(F.min("bucket").alias("bucket"), F.first("c").alias("n")).select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "split")
    held = met(members, split, "bucket", "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    held = held_keys = written(held, "held")
    late_ids = written(held.select(F.col("rep").alias("id")).distinct().join(small(known), "id", "left_anti"), "late")
    more = narrow.join(small(late_ids), "id", "left_semi").mapInArrow(_sets(size), "id long, grams binary")
    # blocks of too many bytes of shingles are cut again
    heavy = written(held.join(sigs.select("rep", "n"), "rep").groupBy("bucket", "block").agg(F.ceil(8 * F.sum("n") / BLOCK_BYTES).cast("int").alias("cuts")).groupBy("bucket").agg(F.max("cuts").alias("cuts")).where("cuts > 1"), "heavy")
    held = held.join(small(heavy), "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    held = held.withColumn("block", F.col("block") * F.col("cuts") + F.pmod(F.xxhash64("rep", "bucket"), "cuts")).withColumn("blocks", F.col("blocks") * F.col("cuts"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    held = held.join(sigs.drop("n"), "rep").join(sets.union(more).withColumnRenamed("id", "rep"), "rep")
    late = held.select("bucket", "lo", "hi", "block", "rep", "comp", "sig", "grams").groupBy("bucket", "lo", "hi").applyInPandas(_confirm_blocks(verifier), "a long, b long")
    edges = written(edges.union(late), "links")
    for table in (reps, star, ids, sigs, alike, known, sets, first, many, split, heavy, held_keys, late_ids):  # nothing later is made of them
        dropped(docs.sparkSession, table)

    last = connected_components(edges, "a", "b")
    named = written(classes.join(last, classes["rep"] == last["id"], "left").select("key", F.coalesce("component", "rep").alias("component_id")), "named")
    out = met(feats.select("id", "n", "key"), named, "key", "id", "left", limit=100_000)
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.eqNullSafe(F.col("id")) | component.isNull()).alias("kept"))
