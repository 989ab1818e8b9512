"""Text functions: folding, tokens, token features, previews, hashes and number or label parsing, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Letters that fold beyond their decomposition, limits of the features (MAX_TOKENS where asked for).
SPECIAL_FROM, SPECIAL_TO = "ışğçöüâîû", "isgcouaiu"
MAX_TOKENS = 400
SHORT_CHARS, SHORT_WORDS = 40, 4
MISSING = ("", "na", "n/a", "nan", "null", "none", "?")


def _decomposed(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """The Latin letters with a mark and their base letters."""
    found = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(first, last + 1)}
    pairs = [(k, v) for k, v in found.items() if v != k and len(v) == 1]
    return "".join(k for k, _ in pairs), "".join(v for _, v in pairs)


def fold(text: Column) -> Column:
    """Lower-cased text without accents; Latin letters only, ``fold_any`` takes all scripts."""
    source, target = _decomposed()
    lower = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.translate(lower, SPECIAL_FROM + source, SPECIAL_TO + target)


@F.pandas_udf(StringType())
def fold_any(text: pd.Series) -> pd.Series:
    """``fold`` by full compatibility decomposition."""
    table = str.maketrans(SPECIAL_FROM, SPECIAL_TO)

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        low = unicodedata.normalize("NFKD", x.replace("İ", "i").lower().translate(table))
        return "".join(c for c in low if not unicodedata.combining(c))

    return text.map(one)


def tokens(text: Column, most: int | None = None) -> Column:
    """The tokens of the whole text; with ``most`` (the usual limit is MAX_TOKENS) the first so many."""
    found = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return found if most is None else F.slice(found, 1, most)


def token_features(toks: Column) -> Column:
    """Distinct ``w:`` words, ``p5:`` beginnings of longer words and ``b:`` pairs with the word before."""
    word = F.transform(toks, lambda t: F.concat(F.lit("w:"), t))
    start = F.transform(F.filter(toks, lambda t: (F.length(t) > 5) & ~t.rlike("^[0-9]+$")), lambda t: F.concat(F.lit("p5:"), F.substring(t, 1, 5)))
    pairs = F.transform(F.arrays_zip(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))).alias("a"), F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))).alias("b")), lambda p: F.concat(F.lit("b:"), p["a"], F.lit("_"), p["b"]))
    return F.array_distinct(F.concat(word, start, pairs))


def token_hashes(toks: Column) -> Column:
    """The hashes (xxhash64) of ``token_features``, told apart as numbers: their names are not kept."""
    less = F.greatest(F.size(toks) - 1, F.lit(0))
    word = F.transform(toks, lambda t: F.xxhash64(F.concat(F.lit("w:"), t)))
    start = F.transform(F.filter(toks, lambda t: (F.length(t) > 5) & ~t.rlike("^[0-9]+$")), lambda t: F.xxhash64(F.concat(F.lit("p5:"), F.substring(t, 1, 5))))
    pairs = F.zip_with(F.slice(toks, 1, less), F.slice(toks, 2, less), lambda a, b: F.xxhash64(F.concat(F.lit("b:"), a, F.lit("_"), b)))
    return F.array_distinct(F.concat(word, start, pairs))


def is_short(text: Column) -> Column:
    return (F.length(text) <= SHORT_CHARS) & (F.size(F.split(F.trim(text), r"\s+")) <= SHORT_WORDS)


def preview(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def state_hash(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def is_missing(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING)


def to_number(text: Column) -> Column:
    """A finite number, a comma read as the decimal point; else null."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~is_missing(text) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def to_label(text: Column) -> Column:
    """The stripped label; whole numbers without ``.0``; null where missing."""
    t = F.trim(text)
    return F.when(~is_missing(text), F.when(t.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t))
