"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Texts are compressed in pieces of so many bytes, so that the dictionary counts all through a long text.
PIECE = 1024
#: What isn't a letter becomes one space, in dictionaries and texts, so that symbols and digits don't count as evidence.
REST = re.compile(r"[\W\d_]+")


def _letters(text: str) -> bytes:
    return f" {REST.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass")


def learn_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, slice_chars: int = 400, max_languages: int = 256) -> dict[str, bytes]:
    """Raw-content dictionaries, one per language: slices of a sample of about ``per_language`` of its texts.

    The bound is ``per_language * slice_chars`` characters (twice that at worst) for each of ``max_languages``; more
    languages raise ValueError.  Different texts are sampled by a hash of the text, repeats once; null texts and languages are left out.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and length(text) > 0")
    hashes = F.xxhash64("text")
    counts = rows.select("lang", hashes.alias("h")).groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1)
    pick = F.pmod(hashes, F.lit(1 << 30))
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - slice_chars) / 2)).cast("int")
    many = counts.collect()
    if len(many) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not many:
        return {}
    chance = F.create_map(*(x for r in many for x in (F.lit(r.lang), F.lit(per_language / r.n * (1 << 30)))))
    found = rows.where(pick < chance[F.col("lang")]).select("lang", hashes.alias("t"), pick.alias("h"), F.substring("text", middle, F.lit(slice_chars)).alias("s"))
    found = found.groupBy("lang", "t", "h").agg(F.min("s").alias("s")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h, r.s)):
        if len(own := out.setdefault(r.lang, [])) < 2 * per_language and (not own or own[-1] != r.s):
            own.append(r.s)
    return {lang: b"".join(map(_letters, x)) for lang, x in out.items()}


def _predict(dictionaries: dict[str, bytes], level: int, fine_level: int, least_margin: float):
    langs = sorted(dictionaries)

    def compressors(at: int) -> list[zstandard.ZstdCompressor]:
        out = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=at)
            out.append(zstandard.ZstdCompressor(level=at, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def sizes_by(own: list[zstandard.ZstdCompressor], raw: bytes) -> np.ndarray:
        return np.array([sum(len(c.compress(raw[at : at + PIECE])) for at in range(0, len(raw), PIECE)) for c in own], dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fine = compressors(level), compressors(fine_level)
        for batch in batches:
            best, score, margin = [], [], []
            for text in batch.column(1).to_pylist():
                if not text or not langs or not any(map(str.isalpha, text)):
                    best.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                raw = _letters(text)
                sizes = sizes_by(own, raw)
                if (sizes == sizes.min()).sum() > 1:
                    sizes = sizes_by(fine, raw)
                i = int(sizes.argmin())
                weight = np.exp2(-(sizes - sizes[i]))
                best.append(langs[i]), score.append(float(weight[i] / weight.sum()))
                margin.append(float((np.delete(sizes, i).min() - sizes[i]) / sizes[i]) if len(sizes) > 1 else 1.0)
            sure = [m >= least_margin and b != "und" for m, b in zip(margin, best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "accepted"])

    return run


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = 6, fine_level: int = 19, least_margin: float = 0.01) -> DataFrame:
    """The language whose dictionary compresses each whole text best.

    Returns one row per input row: ``doc_id, lang_pred, score, margin, accepted``.  ``lang_pred`` is the smallest (ties: by
    ``fine_level``, which finds shorter matches, then the first in code-point order), ``score`` the share of 2^-(extra bytes) it has among all languages, ``margin`` the
    relative distance of the runner-up.  A narrow margin rejects: ``accepted`` is false under ``least_margin``.  Null texts and texts
    without a letter, and all texts if there is no dictionary, are ``und`` with score 0.  Rows are independent: repeated rows
    repeat, null ids are carried, an empty table is empty, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(dictionaries, level, fine_level, least_margin), "doc_id long, lang_pred string, score double, margin double, accepted boolean")
