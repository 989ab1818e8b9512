"""Benchmark decontamination: pigeonhole pieces found exactly, whole items verified by bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.tables import written

REST = re.compile(r"[\W_]+")
#: Characters of scripts written without spaces between words: Thai to Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af]")
#: Benchmark text beyond so many characters is taken in blocks of about this size, one scan of the documents each.
BLOCK_CHARS = 32_000_000


def plain(text: str | None) -> str:
    """Lower-cased words of letters and digits, one space between, before and after them; " " if there is none.

    A character of a script without spaces is a word of its own.
    """
    low = REST.sub(" ", (text or "").lower())
    if not low.isascii():
        low = REST.sub(" ", UNSPACED.sub(r" \g<0> ", low))
    return f" {low.strip()} ".replace("  ", " ")


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """``budget + 1`` runs of nearly equal length that make up ``words``, with their places; ``budget`` edits leave one of them whole."""
    cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A word sequence for Myers' bit-parallel approximate search; any length, as Python's integers are."""

    def __init__(self, words: list[str]) -> None:
        self.m, self.masks = len(words), {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def distance(self, text: list[str]) -> int:
        """The fewest word edits between the pattern and any run of ``text``."""
        ones, high = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = ones, 0, self.m
        best = score
        for w in text:
            eq = self.masks.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (~(xh | plus) & ones), plus & xh
            score += bool(up & high) - bool(down & high)
            up, down = (up << 1) & ones, (down << 1) & ones
            plus, minus = down | (~(xv | up) & ones), up & xv
            best = min(best, score)
        return best


class Searcher:
    """Finds items in texts: an automaton of all their pieces, then the distance of the whole item around each hit."""

    def __init__(self, items: list[tuple[int, str]], percent: int, least_words: int) -> None:
        self.found: dict[str, list[tuple[int, int]]] = {}
        self.own = []
        for item, text in items:
            words = text.split()
            budget = len(words) * percent // 100 if len(words) >= least_words else 0
            for at, piece in pieces(words, budget):
                self.found.setdefault(f" {' '.join(piece)} ", []).append((len(self.own), at))
            self.own.append((item, len(words), budget, Pattern(words)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in self.found.items():
            self.automaton.add_word(piece, (piece.count(" "), places))
        if self.found:
            self.automaton.make_automaton()

    def __call__(self, text: str | None, first_only: bool = False) -> dict[int, int]:
        """The least edits of each item found; with ``first_only``, of one of them."""
        text = plain(text)
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        words: list[str] = []
        seen = spaces = 0
        for end, (gaps, places) in self.automaton.iter(text) if self.found else ():
            words = words or text.split()
            spaces, seen = spaces + text.count(" ", seen, end + 1), end + 1
            first = spaces - gaps  # words before the piece
            for i, at in places:
                item, m, budget, pattern = self.own[i]
                start = first - at
                if (i, start) in tried or best.get(item) == 0:
                    continue
                tried.add((i, start))
                # with no budget the one piece is the whole item
                d = pattern.distance(words[max(0, start - budget) : start + m + budget]) if budget else 0
                if d <= budget:
                    best[item] = min(d, best.get(item, d))
                    if first_only:
                        return best
        return best


def _search(items: list[tuple[int, str]], percent: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(items, percent, least_words)
        for batch in batches:
            best = [search(text) for text in batch.column(1).to_pylist()]
            ids, hits = [sorted(b) for b in best], [[b[k] for k in sorted(b)] for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(ids, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "items", "edits"])

    return run


def _clean(items: list[tuple[int, str]], place: int, percent: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(items, percent, least_words)
        for batch in batches:
            yield batch.filter(pa.array([not search(text, True) for text in batch.column(place).to_pylist()], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> tuple[int, DataFrame]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_chars))
    return count, items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))


def _kept(items: DataFrame, k: int) -> list[tuple[int, str]]:
    return sorted({(r.item, t) for r in items.where(F.col("block") == k).collect() if (t := plain(r.text)).split()})


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 20, least_words: int = 8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which benchmark items each document contains, within an edit budget of ``percent`` of the item's words.

    Text is compared as lower-cased words of letters and digits.  An item of m words within its budget k is cut into k + 1
    pieces; at most k edits leave a piece whole, so every occurrence within the budget has an exact piece hit, which one
    automaton finds in one pass; Myers' distance then compares the whole item with the words around the hit.

    Returns one row per input row: ``doc_id, contaminated, items, edits`` (the items found, ascending, and the least
    edits of each).  Null and empty documents are clean.  Each row is judged by its own text, whatever rows share its id.
    Items with under ``least_words`` words have no budget: they are found where they stand word for word, be it in ordinary
    prose.  Characters of scripts without spaces count as words.  Items without a word or an id are found nowhere; items that
    repeat an id count as one.  Items are broadcast in blocks of at most about ``block_chars`` characters (one item more at worst); a
    larger benchmark is searched block by block over numbered rows, with the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    count, items = _blocks(benchmark, item_col, item_text_col, block_chars)
    if count == 1:
        out = rows.mapInArrow(_search(_kept(items, 0), percent, least_words), "doc_id long, items array<long>, edits array<long>")
    else:
        numbered = written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "numbered")
        blocks = [numbered.select("row", "text").mapInArrow(_search(_kept(items, k), percent, least_words), "doc_id long, items array<long>, edits array<long>").where("size(items) > 0") for k in range(count)]
        each = reduce(DataFrame.union, blocks).select(F.col("doc_id").alias("row"), F.explode(F.arrays_zip("items", "edits")).alias("x")).groupBy("row", "x.items").agg(F.min("x.edits").alias("e"))
        each = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("items", "e"))).alias("x"))
        none = F.array().cast("array<bigint>")
        out = numbered.select("row", "doc_id").join(each, "row", "left").select("doc_id", F.coalesce("x.items", none).alias("items"), F.coalesce("x.e", none).alias("edits"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 20, least_words: int = 8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``find_leaks`` finds clean, with all their columns: a filter of each row by its own text."""
    count, items = _blocks(benchmark, item_col, item_text_col, block_chars)
    for k in range(count):
        docs = docs.mapInArrow(_clean(_kept(items, k), docs.columns.index(text_col), percent, least_words), docs.schema)
        if k < count - 1:
            docs = written(docs, "clean")
    return docs
