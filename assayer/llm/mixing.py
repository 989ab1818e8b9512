"""Mixing sources to target weights: exact block quotas split over output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.llm.tables import met, written

WORD = r"[^\x20\x09-\x0D]+"
#: The plan holds a row for each source and a number for each source and shard; it is made on the driver within this bound.
MAX_PLAN = 1_000_000

#: A block where a target ends falls into so many parts, and only the part where it ends is put in order.
PARTS = 4096

PLAN = T.StructType(
    [T.StructField("src", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("source_size", "blocks")]
    + [T.StructField("target", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("passes", "whole", "part_end")]
    + [T.StructField("need", T.DoubleType()), T.StructField("ends", T.ArrayType(T.LongType()))]
)


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight; a share stops at ``most`` times its size, and the excess is shared again by weight among the others."""
    out, free = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """``(shards, sources)`` counts that sum to ``quotas``: each node of a binary tree draws its left half's blocks without replacement."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    rng = np.random.default_rng([seed, shards, int(quotas.sum())])
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.vstack([split_quotas(drawn, left, 2 * seed + 1), split_quotas(quotas - drawn, shards - left, 2 * seed + 2)])


def row_key(id_: Column, source: Column, text: Column) -> Column:
    """Rows alike in id, source and text have one key, null or not."""
    return F.xxhash64(id_, source.cast("string"), text)


def _cuts(rows: DataFrame, level: str) -> dict[str | None, tuple[int, int]]:
    """For each source the first ``level`` whose running size passes ``need``, and the size before it; none if all fit."""
    sums = rows.groupBy("src", level).agg(F.sum("size").alias("w"), F.first("need").alias("need"))
    sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("src").orderBy(level)))  # max_blocks or PARTS rows of a source at most
    found = sums.groupBy("src").agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct(F.col(level).alias("at"), "upto", "w"))).alias("c")).where("c is not null")
    return {r.src: (r.c["at"], r.c.upto - r.c.w) for r in found.collect()}


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("row_key"))
    return written(sized, "sizes")


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "row_key")


def _blocked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (``src, row_key, ...``) with the plan of their source, ``block`` and ``part``."""
    met_ = rows.join(plan, rows["src"].eqNullSafe(plan["src"])).drop(plan["src"])
    return met_.withColumns({"block": F.pmod(_hashed(seed), "blocks"), "part": F.pmod(_hashed(seed + 3), F.lit(PARTS))})


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: int, shards: int, block_words: int, max_blocks: int, seed: int) -> DataFrame:
    """One row for each source, to be broadcast: where its target ends and how many of its blocks each shard has drawn."""
    totals = sized.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("n")).orderBy(F.col("src").asc_nulls_last()).limit(MAX_PLAN // shards + 1).collect()
    if len(totals) * shards > MAX_PLAN:
        raise ValueError(f"more than {MAX_PLAN // shards} sources with {shards} shards")
    words = [r.words for r in totals]
    targets = share_out(words, [weights[i % len(weights)] for i in range(len(totals))], share * sum(words), most)
    blocks = [min(max_blocks, max(1, -(-w // block_words))) for w in words]
    passes = [min(most, int(t // w)) if w else 0 for t, w in zip(targets, words)]
    srcs = [r.src for r in totals]

    def plan(whole: list[int], part_end: list[int], need: list[float], ends: list[list[int]]) -> DataFrame:
        rows = list(zip(srcs, words, blocks, targets, passes, whole, part_end, need, ends))
        return F.broadcast(sized.sparkSession.createDataFrame(rows, PLAN))

    blocked = lambda p: _blocked(sized, p, seed)
    zeros, none = [0] * len(srcs), [[]] * len(srcs)
    rest = [float(t - p * w) for t, p, w in zip(targets, passes, words)]
    cut = _cuts(blocked(plan(zeros, zeros, rest, none)), "block")
    # blocks without documents count as taken
    whole = [cut.get(s, (b if x > 0 else 0, 0))[0] for s, b, x in zip(srcs, blocks, rest)]
    need = [x - cut[s][1] if s in cut else 0.0 for s, x in zip(srcs, rest)]
    end = _cuts(blocked(plan(whole, zeros, need, none)).where("block = whole and need > 0"), "part")
    part_end = [end.get(s, (0, 0))[0] for s in srcs]
    last = [x - end[s][1] if s in end else 0.0 for s, x in zip(srcs, need)]
    quotas = np.array([p * b + q + (x > 0) for p, b, q, x in zip(passes, blocks, whole, need)], dtype=np.int64)
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0).T.tolist() if len(totals) else []
    return plan(whole, part_end, last, ends)


#: Rows of the part where a source's target ends; the others have as many copies as their block and part say.
EDGE = "block = whole and part = part_end and need > 0"


def _others(placed: DataFrame) -> DataFrame:
    return placed.where(f"not ({EDGE})").withColumn("extra", F.expr("block < whole or block = whole and part < part_end").cast("int"))


def _some(placed: DataFrame, seed: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(_hashed(seed + 1), "row_key").rowsBetween(Window.unboundedPreceding, 0)
    return placed.where(EDGE).withColumn("extra", (F.sum("size").over(order) - F.col("size") / 2 <= F.col("need")).cast("int"))


def _draws(copies: Column, seed: int) -> Column:
    """``(pass, shard, key)`` of each copy."""
    place = lambda e: e * F.col("blocks") + F.col("block")
    draw = lambda e: F.struct(e.alias("pass"), F.size(F.filter("ends", lambda o: o <= place(e))).alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("row_key"), e).alias("key"))
    return F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), draw)).otherwise(F.array().cast("array<struct<pass:int,shard:int,key:bigint>>"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, shards: int = 64, block_words: int = 4096, max_blocks: int = 4096, seed: int = 1) -> DataFrame:
    """How often, and into which shards, each document goes.

    Sources in code-point order, null last, have ``weights`` in turn.  ``share`` of all words is shared out by weight,
    no source beyond ``most`` times its size.  A source's documents fall into blocks by a hash of their ``row_key``, so block
    numbers are a random permutation; a target is so many whole passes over the blocks, then whole blocks in order, then
    parts of one last block, then documents of one last part up to the target.  The splitting tree gives each shard its count
    of every source's blocks, and a shard draws the next so many: shards are disjoint and exhaust the quotas exactly.

    Returns one row per input row: ``doc_id, source, size, source_size, target, taken, copies``, ``draws``, an array of
    ``(pass, shard, key)``, and ``row_key``; ordering a shard by ``key`` shuffles it.  Null text has size 0; a document of size 0
    takes no words.  Null ids are ids like others.  Equal rows are drawn alike but for the last part, which may take only some of them.
    An empty table gives an empty result.  Only sums by source and by (source, block) are shuffled, with partial sums; the plan is
    one row per source, and more than ``MAX_PLAN`` numbers raise ValueError.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    placed = _blocked(sized, _plan(sized, weights, share, most, shards, block_words, max_blocks, seed), seed)
    copies = (F.col("passes") + F.col("extra")).cast("int")
    return _others(placed).unionByName(_some(placed, seed)).select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), _draws(copies, seed).alias("draws"), "row_key")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, shards: int = 64, block_words: int = 4096, max_blocks: int = 4096, seed: int = 1) -> DataFrame:
    """``draw_rows(docs, mix_sources(docs, ...))`` without a join: a row's draws follow from its key and the plan, which is broadcast.

    Texts are shuffled once, into their shards.  Only rows of the part where a source's target ends are looked up, as which
    of them have one more draw depends on their order; equal ones among them are numbered within each split of the input, after the splits'
    counts before it, so that no task holds all copies of a row.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan = _plan(sized, weights, share, most, shards, block_words, max_blocks, seed)
    more = _some(_blocked(sized, plan, seed), seed).groupBy("row_key").agg(F.sum("extra").alias("more")).where("more > 0")
    more = written(more, "more")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source_col).cast("string").alias("src"), row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("row_key"), F.monotonically_increasing_id().alias("n"))
    placed = _blocked(rows, plan, seed)
    ends = written(met(placed.where(EDGE), more, "row_key", "n", "left").withColumn("split", F.shiftright("n", 33)), "ends")
    counts = ends.where("more is not null").groupBy("row_key", "split").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("row_key").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # one row for each split of the input
    counts = written(counts.select(F.struct("row_key", "split").alias("at"), F.coalesce(before, F.lit(0)).alias("before")), "before")
    place = F.row_number().over(Window.partitionBy("row_key", "split").orderBy("n")) + F.coalesce("before", F.lit(0))
    ends = met(ends.withColumn("at", F.struct("row_key", "split")), counts, "at", "n", "left")
    ends = ends.withColumn("extra", (place <= F.coalesce("more", F.lit(0))).cast("int"))
    copies = (F.col("passes") + F.col("extra")).cast("int")
    each = lambda df: df.select("doc", F.explode(_draws(copies, seed)).alias("d"))
    return _in_shards(each(_others(placed)).unionByName(each(ends)), docs.columns)


def _in_shards(out: DataFrame, columns: list[str]) -> DataFrame:
    out = out.repartitionByRange("d.shard", "d.key").sortWithinPartitions("d.shard", "d.key")
    return out.select(*(F.col("doc").getField(c).alias(c) for c in columns if c != "shard"), F.col("d.shard").alias("shard"))


def draw_rows(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, once for each draw, with ``shard``, dealt by shard and key and in shuffled order within each part.

    A row is found by its ``row_key``.  Rows alike have one list of draws, which is joined once, so they aren't
    multiplied; null ids are found like others.  Only where a source's target ends can some of them have a draw more than
    the others; those are numbered.  All columns of ``docs`` stay, whatever their names; one called ``shard`` is replaced.
    """
    lists = mix.groupBy(F.col("row_key").alias("key")).agg(
        F.min("copies").alias("low"), F.max("copies").alias("high"), F.max(F.struct("copies", "draws"))["draws"].alias("draws"), F.count("*").alias("rows"), F.sum("copies").alias("sum")
    ).where("high > 0")
    lists = written(lists, "draws")
    doc = F.struct(*docs.columns).alias("doc")
    rows = docs.select(doc, row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("n"))
    found = met(rows, lists, "key", "n", limit=50_000)
    alike = found.where("low = high").withColumn("copies", F.col("high"))
    # copies differ by one: so many of the rows have the higher number
    order = Window.partitionBy("key").orderBy("n")
    mixed = found.where("low < high").withColumn("copies", F.when(F.row_number().over(order) <= F.col("sum") - F.col("rows") * F.col("low"), F.col("high")).otherwise(F.col("low")))
    out = alike.unionByName(mixed).select("doc", F.explode(F.slice("draws", F.lit(1), F.col("copies"))).alias("d"))
    return _in_shards(out, docs.columns)
