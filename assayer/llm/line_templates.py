"""Line dedup by log templates: a fixed-depth tree of token count and leading tokens, templates in its leaves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from assayer.llm.neardup import near_duplicates
from assayer.llm.tables import dropped, hashed, met, small, written

#: Tokens that vary between uses of a template: those with a digit, addresses and links.
VARIABLE = re.compile(rb"[0-9@]|://")
WILDCARD = b"<*>"
#: So many distinct lines of a leaf are compared with one another; a larger leaf is first cut into parts, and so is a run that more heads share.
PART = 2048
#: Texts whose sets of so many-word runs have a similarity of so many percent are of one family.
FAMILY_WORDS, FAMILY_PERCENT = 3, 80
#: Bands and rows of their signatures: of two texts at that similarity 3 in 100,000 pairs share no band.
FAMILY_ROWS, FAMILY_BANDS = 4, 20


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def masked(line: str) -> list[bytes]:
    """The tokens of a line, variable ones replaced by a wildcard."""
    raw = line.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    return [WILDCARD if VARIABLE.search(t) else t for t in tokens] if VARIABLE.search(raw) else tokens


def _lines(depth: int, least_tokens: int):
    """Rows of the lines that can have a template: enough tokens, and at least as many constants as wildcards."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "doc_id", "copy", "no", "n", "leaf", "line", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, copy, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, x in enumerate((text or "").split("\n")):
                    t = masked(x)
                    n = len(t)
                    if n < least_tokens:
                        continue
                    constants = n - t.count(WILDCARD)
                    if constants < least_tokens or 2 * constants < n:
                        continue
                    whole = b" ".join(t)
                    rows.append((key, doc_id, copy, no, n, _signed(xxh3_64_intdigest(b"%d %s" % (n, b" ".join(t[:depth])))), _signed(xxh3_64_intdigest(whole)), whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)

    return run


def _needed(n: int, similar: float) -> int:
    """The fewest equal places of two lines of ``n`` tokens that have one template."""
    return int(np.ceil(n * similar - 1e-9))


def _cuts(n: int, similar: float, depth: int) -> list[int]:
    """The bounds of the runs of places, one of which two lines of one template share whole."""
    first, runs = min(depth, n), n - _needed(n, similar) + 1
    return [first + (n - first) * i // runs for i in range(runs + 1)]


def assign_templates(lines: list[int], texts: list[bytes], similar: float, depth: int) -> list[int]:
    """The template of each line of a part of a leaf: the first that it shares enough tokens with, place by place, or its own.

    The leading tokens are equal in a leaf.  A line differs from its template in ``n - need`` of the other places at
    most, so of one run of places more than that it shares one whole: only heads with such a run are compared.
    """
    if len(lines) == 1:
        return lines
    tokens = np.array([hashed(t.split()) for t in texts])
    n = tokens.shape[1]
    need = _needed(n, similar)
    cuts = [8 * c for c in _cuts(n, similar, depth)]
    runs: dict[tuple[int, bytes], list[int]] = {}
    names, heads, out = [], [], []
    for i, line in enumerate(lines):
        raw = tokens[i].tobytes()
        own = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        near = sorted({h for k in own for h in runs.get(k, ())})
        same = (tokens[[heads[h] for h in near]] == tokens[i]).sum(axis=1) >= need if near else ()
        if any(same):
            out.append(names[near[int(np.argmax(same))]])
            continue
        for k in own:
            runs.setdefault(k, []).append(len(names))
        names.append(line), heads.append(i), out.append(line)
    return out


def _templates(similar: float, depth: int):
    names = ["leaf", "line", "template", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf, part and line; a part, of about PART rows, is held at a time."""
        part, lines, texts, done = None, [], [], []

        def close() -> None:
            if lines:
                done.extend(zip([part[0]] * len(lines), lines, assign_templates(lines, texts, similar, depth), texts))

        def flush() -> pa.RecordBatch:
            cols = zip(*done) if done else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)

        for batch in batches:
            for leaf, no, line, text in zip(*(batch.column(c).to_pylist() for c in ("leaf", "part", "line", "tokens"))):
                if (leaf, no) != part:
                    close()
                    part, lines, texts = (leaf, no), [], []
                lines.append(line), texts.append(text)
            if done:
                yield flush()
                done = []
        close()
        yield flush()

    return run


def _runs(similar: float, depth: int):
    """``bucket, line, tokens`` of each run of places of each line; an empty run is shared by the whole leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for i, (leaf, text) in enumerate(zip(batch.column("leaf").to_pylist(), batch.column("tokens").to_pylist())):
                t = text.split()
                cuts = _cuts(len(t), similar, depth)
                keys += [_signed(xxh3_64_intdigest(b"%d %d %s" % (leaf, a, b" ".join(t[a:b])))) for a, b in zip(cuts, cuts[1:])]
                at += [i] * (len(cuts) - 1)
            own = batch.select(["line", "tokens"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *own.columns], ["bucket", "line", "tokens"])

    return run


def _similar_pairs(similar: float):
    """Edges ``a, b`` (a < b) among the lines of a bucket's block or between its two; rows come sorted by bucket and blocks."""

    def pairs(rows: list[tuple[int, int, bytes]], across: bool) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        ids, blocks = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
        split = [r[2].split() for r in rows]
        out = []
        for n in {len(t) for t in split}:  # one, but for a clash of hashes
            at = np.flatnonzero([len(t) == n for t in split])
            tokens = np.array([hashed(split[i]) for i in at])
            for k in range(len(at) - 1):
                near = (tokens[k + 1 :] == tokens[k]).sum(axis=1) >= _needed(n, similar)
                if across:
                    near &= blocks[at[k + 1 :]] != blocks[at[k]]
                out += [(min(ids[at[k]], ids[j]), max(ids[at[k]], ids[j])) for j in at[k + 1 :][near]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, done = None, [], []
        for batch in batches:
            for bucket, lo, hi, block, line, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "block", "line", "tokens"))):
                if (bucket, lo, hi) != last:
                    done += pairs(rows, bool(rows) and last[1] != last[2])
                    last, rows = (bucket, lo, hi), []
                rows.append((line, block, text))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], ["a", "b"])
                done = []
        done += pairs(rows, bool(rows) and last[1] != last[2])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done) if done else [[]] * 2)], ["a", "b"])

    return run


def _edges(heads: DataFrame, similar: float, depth: int) -> DataFrame:
    """All pairs of similar heads of a leaf: they share a run, and the heads of a run are compared in blocks of about ``PART``."""
    runs = written(heads.mapInArrow(_runs(similar, depth), "bucket long, line long, tokens binary"), "runs")
    blocks = runs.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", F.ceil(F.col("c") / PART).cast("int").alias("blocks"))
    held = runs.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    held = held.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "block", "line", "tokens")
    return held.mapInArrow(_similar_pairs(similar), "a long, b long").distinct()


def _leaders(edges: DataFrame) -> DataFrame:
    """``line, last``: the least leader that each line with one is similar to, as if the lines were parsed one after another.

    A line without a lesser neighbour leads; its neighbours follow and lead nobody; and so on with the rest.  Lines are
    hashes, so the order is random and the rounds are few.
    """
    spark, now, found = edges.sparkSession, edges, []
    while not now.isEmpty():
        leaders = written(now.select(F.col("a").alias("line")).distinct().join(now.select(F.col("b").alias("line")), "line", "left_anti"), "leaders")
        found.append(leaders)
        follow = written(now.join(leaders, F.col("a") == F.col("line"), "left_semi").select(F.col("b").alias("line")).distinct(), "followers")
        gone = leaders.union(follow)
        last = now
        now = written(now.join(gone, F.col("a") == F.col("line"), "left_anti").join(gone, F.col("b") == F.col("line"), "left_anti"), "open")
        if last is not edges:
            dropped(spark, last)
    if not found:
        return spark.createDataFrame([], "line long, last long")
    leaders = reduce(DataFrame.union, found)
    return edges.join(leaders, F.col("a") == F.col("line"), "left_semi").groupBy(F.col("b").alias("line")).agg(F.min("a").alias("last"))


def line_templates(texts: DataFrame, similar: float, depth: int) -> DataFrame:
    """``line, last``, the template of each line that isn't its own, for distinct ``leaf, line, tokens``.

    A leaf of more than ``PART`` lines is parsed in parts; then all similar pairs of the parts' heads are found by the runs
    of places that they share, and the heads are parsed over these pairs, so that no two templates of a leaf are similar.
    """
    parts = written(texts.groupBy("leaf").agg(F.ceil(F.count("*") / PART).alias("parts")), "parts")
    rows = texts.join(parts, "leaf").withColumn("part", F.pmod("line", "parts")).select("leaf", "part", "line", "tokens")
    rows = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "line")
    once = written(rows.mapInArrow(_templates(similar, depth), "leaf long, line long, template long, tokens binary"), "templates")
    large = parts.where("parts > 1")
    own = once.where("line <> template").select("line", F.col("template").alias("last"))
    if large.isEmpty():
        return own
    heads = once.where("line = template").select("leaf", "line", "tokens").join(large, "leaf", "left_semi")
    moved = written(_leaders(written(_edges(heads, similar, depth), "pairs")), "moved")
    to = moved.select(F.col("line").alias("template"), "last")
    named = once.join(to, "template", "left").select("line", F.coalesce("last", "template").alias("last"))
    return named.where("line <> last")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similar: float = 0.8, least_tokens: int = 5, long_tokens: int = 20, uses: int = 3, long_uses: int = 2) -> DataFrame:
    """``key, no``: the lines to drop, by row key (``row_key``) and line number from 0.

    A line's tokens, those with digits and addresses masked, go down a tree of fixed depth: token count, then ``depth``
    leading tokens.  In a leaf, lines that agree in a ``similar`` share of places have one template.  Exact repeats are
    one line there; a leaf of more than ``PART`` distinct lines is parsed in parts, and then all the parts' templates together (``line_templates``).

    A template recurs if texts of ``uses`` families (``long_uses``, from ``long_tokens`` tokens on) have it.  A family is a
    component of near copies (``near_duplicates`` with ``FAMILY_WORDS`` and ``FAMILY_PERCENT``), whatever its size.  So a
    passage put into many documents recurs, however many copies these have, and the lines of a document and its exact and
    near copies alone don't: those are left to near-dedup.  The row with the least id (then key; null last) keeps a recurring template.
    Lines with fewer than ``least_tokens`` constant tokens, or more wildcards than constants, have no template.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    lines = written(rows.mapInArrow(_lines(depth, least_tokens), "key long, doc_id long, copy long, no int, n int, leaf long, line long, tokens binary"), "lines")
    spark = docs.sparkSession
    shared = written(lines.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("leaf"), "leaves")
    texts = lines.select("leaf", "line", "tokens").join(small(shared), "leaf")
    texts = written(texts.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")), "distinct")
    merged = written(line_templates(texts, similar, depth), "merged")

    # a frequent line is no hot key of a join: see met
    named = met(lines.drop("leaf", "tokens"), merged, "line", "key", "left").withColumn("line", F.coalesce("last", "line")).drop("last")
    several = written(named.groupBy("line").agg(F.min("copy").alias("a"), F.max("copy").alias("b")).where("a <> b").select("line"), "several")
    used = written(met(named, several, "line", "key", "left_semi"), "uses")
    for table in (lines, shared, texts, merged, several):  # nothing later is made of them
        dropped(spark, table)
    pairs = written(used.groupBy("line", "copy").agg(F.max("n").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "key")).alias("first")), "pairs")
    least = F.when(F.col("n") >= long_tokens, long_uses).otherwise(uses)
    # a template has as many texts as families at least, so the texts of other templates need no family
    often = pairs.groupBy("line").agg(F.count("*").alias("texts"), F.max("n").alias("n")).where(F.col("texts") >= least).select("line")
    often = written(often, "often")
    held = met(pairs, often, "line", "copy", "left_semi")
    # one row of each text stands for it; rows alike in id and text too are one document to near_duplicates
    copies = written(held.groupBy("copy").agg(F.min("first")["key"].alias("key")), "copies")
    texts = rows.select("key", "copy", "text").join(small(copies.select("key")), "key", "left_semi").select("copy", "text")
    families = near_duplicates(written(texts, "texts"), "copy", "text", FAMILY_WORDS, FAMILY_PERCENT, FAMILY_ROWS, FAMILY_BANDS).select(F.col("doc_id").alias("copy"), F.col("component_id").alias("family")).distinct()
    per = held.join(families, "copy").groupBy("line", "family").agg(F.max("n").alias("n"), F.min("first").alias("first"))
    per = per.groupBy("line").agg(F.count("*").alias("families"), F.max("n").alias("n"), F.min("first").alias("first"))
    recurring = written(per.where(F.col("families") >= least).select("line", F.col("first.key").alias("keeper")), "recurring")
    return met(used, recurring, "line", "key").where("key <> keeper").select("key", "no")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, **options) -> DataFrame:
    """``docs`` without recurring lines (see ``recurring_lines``): all rows, all columns, ``text_col`` rewritten.

    With ``report``, ``doc_id, n_lines, n_dropped, text`` instead.  Texts without such lines, nulls and empty texts stay as they
    are; a document may become empty.  Rows alike in id and text are rewritten alike.  Other columns are carried, whatever their names.
    """
    drops = written(recurring_lines(docs, id_col, text_col, **options), "drops")
    drops = written(drops.groupBy("key").agg(F.collect_set("no").alias("drop")), "by_row")
    joined = met(docs.select(F.struct(*docs.columns).alias("doc"), row_key(id_col, text_col).alias("key")), drops, "key", "key", "left")
    of = lambda c: F.col("doc").getField(c)
    parts = F.split(of(text_col), "\n", -1)
    text = F.when(F.col("drop").isNull(), of(text_col)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    if not report:
        return joined.select(*((text if c == text_col else of(c)).alias(c) for c in docs.columns))
    n = F.coalesce(F.size(parts), F.lit(0))
    return joined.select(of(id_col).alias("doc_id"), F.when(n > 0, n).otherwise(0).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))
