"""Phrase collocations: n-grams exploded into rows and counted per language, scored at their weakest cut, without those a longer one stands for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.tables import hashed, mixed, written

#: What ends a piece, and what parts words within one.
BREAKS = ".,;:!?\n\x0b\f\r"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
#: Least and most bits of the filter of frequent phrases; one of the most bits is 32 MB, whatever the corpus.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bits for each frequent phrase while there is room.
BITS = 16
#: A run of words is cut into stretches of so many first words, which overlap by what an n-gram needs.
STRETCH = 1000
#: First winners of each language are taken by so many parts, then of the parts' winners.
PARTS = 32

_FOLD = bytes(10 if chr(b) in BREAKS else 32 if b == 9 else b for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keys(lang: bytes, h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of each row of ``size`` neighbours among the hashed words of a language."""
    key = np.full(max(len(h) - size + 1, 0), hashed([lang])[0] + np.uint64(size), np.uint64)
    for i in range(size):
        key = mixed(key * np.uint64(31) + h[i : i + len(key)])
    return key


def _set_bits(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """The filter: one bit for each phrase of ``size`` words in ``frequent``; at most ``bits / 64`` numbers reach the driver."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_keys(lang, hashed(phrase.split(b" ")), size)[0] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            at = np.unique(np.array(keys, np.uint64) & np.uint64(bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))], ["at", "bits"])

    rows = frequent.select(F.col("lang").cast("binary"), F.col("phrase").cast("binary")).mapInArrow(parts, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    found = np.zeros(bits // 64, np.uint64)
    found[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return found


def frequent_runs(docs: DataFrame, frequent: DataFrame, size: int, more: int) -> DataFrame:
    """``lang, run``: the stretches of a piece whose phrases of ``size`` words are all frequent, long enough for one of ``size + 1`` words.

    No n-gram that holds a rarer phrase can be frequent, so none is lost; the filter may let rarer ones pass, which are counted
    and dropped later.  It has at most ``MOST_BITS`` bits: where the frequent phrases outgrow it, it holds back less.
    """
    n = frequent.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * n).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_set_bits(frequent, size, bits))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words: list[bytes] = []
                for piece in text.lower().translate(_FOLD).split(b"\n"):
                    words += piece.split()
                    words.append(b"")  # no phrase goes over the end of a piece
                key = _keys(lang, hashed(words), size) & np.uint64(bits - 1)
                ok = (known[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)).astype(bool)
                gaps = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) == 0)
                for i in range(size):  # a phrase that begins up to an end of a piece, or crosses it
                    ok[(gaps - i)[(gaps >= i) & (gaps - i < len(ok))]] = False
                edges = np.flatnonzero(np.diff(ok, prepend=False, append=False))
                begins, ends = edges[::2], edges[1::2] + size - 1  # the last phrase of a run has size words
                long = ends - begins > size
                stretches = [b" ".join(words[i : min(i + STRETCH + more - 1, b)]) for a, b in zip(begins[long].tolist(), ends[long].tolist()) for i in range(a, b, STRETCH)]
                if stretches:
                    langs.append(lang)
                    out.append(b"\n".join(stretches))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()), pa.array(out, pa.binary())], ["lang", "runs"])

    rows = docs.select(F.col("lang").cast("binary"), F.col("text").cast("binary")).mapInArrow(runs, "lang binary, runs binary")
    return rows.select(F.col("lang").cast("string").alias("lang"), F.explode(F.split(F.col("runs").cast("string"), "\n")).alias("run"))


def exploded(runs: DataFrame, sizes: range) -> DataFrame:
    """``lang, phrase``: one row for each n-gram of the stretches, of each of ``sizes``; an n-gram counts in the stretch it begins in."""
    w = F.col("_w")

    def grams(n: int) -> Column:
        firsts = F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.size(w) - n + 1))
        return F.when(F.size(w) >= n, F.transform(firsts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return runs.withColumn("_w", F.split("run", " ")).select("lang", F.explode(F.concat(*map(grams, sizes))).alias("phrase"))


def phrase_counts(docs: DataFrame, max_n: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of 1 to ``max_n`` words that occur ``least`` times or more, and ``lang, n``, all words.

    ``docs`` has ``lang`` and ``text`` without nulls.  Words, pairs, and longer phrases are counted in three rounds of explode and
    hash aggregation; each round explodes only what the round before left frequent.
    """
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))).alias("phrase"))
    counted = words.groupBy("lang", "phrase").agg(F.count("*").alias("f"))
    # rare words are summed into one row for each language, with a null phrase
    kept = counted.withColumn("phrase", F.when(F.col("f") >= least, F.col("phrase"))).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    kept = written(kept, "words")
    totals = kept.groupBy("lang").agg(F.sum("f").alias("n"))
    rounds = [kept.where("phrase is not null").select("lang", "phrase", F.lit(1).alias("size"), "f")]
    for size, sizes in ((1, range(2, 3)), (2, range(3, max_n + 1))):
        if len(sizes):
            grams = exploded(frequent_runs(docs, rounds[-1], size, max(sizes)), sizes)
            found = grams.groupBy("lang", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least)
            rounds.append(written(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "phrases"))
    counts = rounds[0]
    for more in rounds[1:]:
        counts = counts.union(more)
    return counts, totals


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Phrases whose words occur together more often than apart, the first ``top`` of each language.

    Returns ``lang, rank, phrase, a, l, r, n, score``: A-Z is lower-cased, texts are split at punctuation and line ends into
    pieces, pieces at spaces and tabs into words.  A phrase of 2 to ``max_n`` words within a piece is a candidate if it occurs
    ``least`` times or more; ``a`` is its count, ``l`` and ``r`` those of the two parts of the cut with the least
    ``score = floor(1000 * a * n / (l * r))``, the first of equal ones, and ``n`` the language's words.  Scores are whole
    decimals, exact for counts below 10^16 (a larger one raises).  A candidate inside a longer one that is as frequent is dropped; it is then
    also inside one that is longer by one word, so only those are looked up.

    A null text counts as empty, a null language as ``und``; repeated rows count again; a text of any length is read whole, and
    its n-grams are exploded in stretches.  Equal scores are ranked by count, then by the phrase's bytes, so reruns agree.  An empty
    table, or one without frequent phrases, gives no rows; other columns are ignored.

    At scale: counts are summed before each shuffle, so a hot phrase is one row of a task; the filter of frequent phrases is of
    bounded size, and all else about phrases is joined by shuffle.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, totals = phrase_counts(texts, max_n, least)
    many = counts.where("size > 1")
    cuts = many.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"_l": F.expr("substring_index(phrase, ' ', k)"), "_r": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda c, f: counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    cuts = cuts.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"]).join(F.broadcast(totals), "lang")  # one row for each language
    whole = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"_top": F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), "_low": whole("l") * whole("r")})
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("_top div _low").alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    longer = many.where("size > 2")
    inside = longer.select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    kept = scored.join(inside, (scored["lang"] == inside["lang"]) & (scored["phrase"] == inside["phrase"]) & (inside["_f"] >= scored["a"]), "left_anti")
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", rank("lang", "_p")).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
