"""Source divergence audit: sources of a language compared by joint count histograms, and the terms that set a source apart."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.tables import small, written

#: Shares are whole numbers out of so many; documents that a kept term is in; terms reported for each group.
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Winners of a group are first taken by so many parts of its terms.
PARTS = 32
#: A task sums up so many terms of its groups before it hands them on; a long text is parted in stretches of so many bytes.
HELD, STRETCH = 1_000_000, 1 << 22

#: Letters fold to lower case, bytes beyond ASCII stay, all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))``, a long, by decimals; null if nothing is kept."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + F.lit(1).cast("decimal(1,0)"))
    return F.lit(1) + F.call_function("div", top, F.call_function("nullif", whole(total) + whole(kept), F.lit(0).cast("decimal(1,0)")))


def gap(p: Column | str, q: Column | str) -> Column:
    """``floor((p - q) * (p - q) / q)``; shares are at most SCALE + 1, so the square fits a long."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded stretch each."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, d``: occurrences and rows of each term in each group, summed up over a bounded number of terms."""
    n, d = defaultdict(Counter), defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            rows = d[lang, source]
            columns = [pa.array([x] * len(counts), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([rows[t] for t in counts], pa.int64())], ["lang", "source", "term", "n", "d"])
        n.clear()
        d.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            group, seen = (lang, source), set()
            for terms in _stretches(text.translate(_FOLD)):
                n[group].update(terms)
                seen.update(terms)
            d[group].update(seen)
        if sum(map(len, n.values())) > HELD:
            yield from out()
    yield from out()


def term_vectors(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term, total, counts``: each term of ``least`` documents or more of its language, and its counts by source, as an array sorted by source.

    ``texts`` has ``lang, source, text`` without nulls.  Occurrences and documents are summed before each shuffle.
    """
    found = texts.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_sums, "lang string, source string, term binary, n long, d long")
    counts = found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    vectors = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("_d"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return vectors.where(F.col("_d") >= least).drop("_d")


def joint_histograms(vectors: DataFrame, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, s, t, a, b, m``: for each pair of sources (s before t), how many kept terms occur ``a`` times in s and ``b`` times in t, zeros included.

    ``pairs`` has ``lang, s, t``, ``kept`` has ``lang, kept``.  Terms with the same counts everywhere are one vector with a multiplicity, so pairs
    of sources are made once for each different vector.  Only cells without a zero are counted; those with one follow: a term of s that isn't
    in t is one of s's histogram less those it shares.
    """
    alike = vectors.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    alike = written(alike, "vectors")
    left = alike.where(F.size("counts") > 1).select("lang", "counts", "m", F.posexplode("counts").alias("i", "x"))
    both = left.select("lang", "x", "m", F.explode(F.slice("counts", F.col("i") + 2, F.size("counts"))).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("s"), F.col("y.source").alias("t"), F.col("x.n").alias("a"), F.col("y.n").alias("b")).agg(F.sum("m").alias("m"))
    single = alike.select("lang", F.explode("counts").alias("x"), "m").groupBy("lang", F.col("x.source").alias("g"), F.col("x.n").alias("n")).agg(F.sum("m").alias("m"))
    single = written(single, "histograms")
    none = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, n, m = (F.col(c) for c in "abnm")
    signed = [
        both.select("lang", "s", "t", F.explode(F.array(cell(a, b, m), cell(a, none, -m), cell(none, b, -m), cell(none, none, m))).alias("c")),
        pairs.join(single.withColumnRenamed("g", "s"), ["lang", "s"]).select("lang", "s", "t", F.explode(F.array(cell(n, none, m), cell(none, none, -m))).alias("c")),
        pairs.join(single.withColumnRenamed("g", "t"), ["lang", "t"]).select("lang", "s", "t", F.explode(F.array(cell(none, n, m), cell(none, none, -m))).alias("c")),
        pairs.join(kept, "lang").select("lang", "s", "t", cell(none, none, F.col("kept")).alias("c")),
    ]
    return reduce(DataFrame.union, signed).select("lang", "s", "t", "c.*").groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")).where("m > 0")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How far each source is from each other source of its language, and by which terms it differs from the language.

    Returns ``lang, source, part, item, value, rank``.  Terms are runs of letters and of anything beyond ASCII, A-Z lower-cased; a language keeps
    those of ``least`` documents (rows) or more.  A group's share of a kept term is ``share(its count, the group's count of kept terms, number of
    kept terms)``; unlike shares p and q are ``gap(p, q)`` apart.  Part ``pair``: the item is each other source of the language, the value the sum of
    ``gap`` over all kept terms, from joint histograms: one evaluation for each pair of counts, times how many terms have it.  Part ``term``: the item is
    each kept term that the group has and whose share is above the language's, to rank ``top``.  Ranks are by value, then the item's bytes.

    Null text, language and source count as ''.  A source without terms is compared all the same, a language that keeps nothing gives
    pairs of value 0, a lone source has no pair; repeated rows count again; an empty table gives no rows; other columns are ignored.
    A sum beyond 64 bits raises.

    At scale: all about terms is summed before it is shuffled and joined by shuffle; a row holds a term's counts by source, and the result the square of
    the sources of a language.  First terms of a hot group are taken by parts.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    vectors = written(term_vectors(texts, least), "terms")
    groups = texts.select("lang", "source").distinct()
    langs = vectors.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    sizes = vectors.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("size"))
    stats = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    stats = written(stats.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size", "kept", "all"))), "groups")
    side = lambda g: small(stats).select("lang", F.col("source").alias(g), F.col("size").alias(f"_{g}"), *(["kept"] if g == "s" else []))
    pairs = stats.select("lang", F.col("source").alias("s")).join(stats.select("lang", F.col("source").alias("t")), "lang").where("s < t")  # as many as the result has, halved
    cells = joint_histograms(vectors, pairs, stats.groupBy("lang").agg(F.first("kept").alias("kept")))
    cells = cells.join(side("s"), ["lang", "s"]).join(side("t"), ["lang", "t"]).withColumns({"_p": share("a", "_s", "kept"), "_q": share("b", "_t", "kept")})
    sum_of = lambda p, q: F.sum(gap(p, q).cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)"))
    values = cells.groupBy("lang", "s", "t").agg(sum_of("_p", "_q").alias("st"), sum_of("_q", "_p").alias("ts"))
    apart = pairs.join(values, ["lang", "s", "t"], "left")
    way = lambda g, i, v: F.struct(F.col(g).alias("source"), F.col(i).alias("item"), F.coalesce(F.col(v).cast("long"), F.lit(0).cast("long")).alias("value"))
    apart = apart.select("lang", F.explode(F.array(way("s", "t", "st"), way("t", "s", "ts"))).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "x.value")
    order = [F.desc("value"), F.asc("item")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", "source", *keys).orderBy(*order))
    apart = apart.withColumn("rank", rank())
    terms = vectors.select("lang", "term", "total", F.explode("counts").alias("x")).select("lang", "x.source", F.col("term").alias("item"), "total", "x.n")
    terms = terms.join(small(stats), ["lang", "source"]).withColumns({"_p": share("n", "size", "kept"), "_q": share("total", "all", "kept")}).where("n > 0 and _p > _q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", gap("_p", "_q").alias("value"), F.pmod(F.xxhash64("item"), F.lit(PARTS)).alias("_part"))
    terms = terms.withColumn("rank", rank("_part")).where(F.col("rank") <= top).drop("_part", "rank").withColumn("rank", rank()).where(F.col("rank") <= top)
    return apart.union(terms)
