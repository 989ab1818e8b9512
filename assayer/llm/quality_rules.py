"""Quality rules as a ledger: every rule is evaluated once into a bit, policies and ablations are bit operations on it.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: The rules in bit order, over the measurements: a rule holds for a document that fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "10 * word_chars < 20 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "capitals": "100 * n_upper > 50 * word_chars",
    "few_letters": "100 * n_letters < 50 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("2024.1", tuple(RULES))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three words that the array holds twice or more.

    Windows are sorted with their place, so equal ones are neighbours: n log n for any text.
    """
    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("t"), i.alias("i")))

        def among(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["t"] == F.get(s, j)["t"], F.lit(False))
            again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(*(F.get(s, i)["i"] + F.lit(d) for d in range(3)))))))

        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows, lambda v: F.when(F.size(F.array_distinct(F.transform(v, lambda x: x["t"]))) == F.size(v), F.lit(0)).otherwise(_let(F.array_sort(v), among))))

    return _let(words, of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements, all long; null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return rows.select(
        "doc_id",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        without(GAP).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("n_repeat_words"),
        (F.length(text) - without("[A-Z]+")).cast("long").alias("n_upper"),
        (F.length(text) - without(r"\p{L}+")).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each row and ``failed``, a long with the bit of every rule that the document fails.

    Every rule is evaluated here, once; integers only, so no result depends on rounding.  Null, empty and blank texts
    have no words and fail ``few_words`` only.  Rows are independent: repeated rows repeat, an empty table is empty.
    """
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed", total)


def verdict(policy: Policy, failed: str = "failed") -> Column:
    """True where a document of the ledger passes all rules of ``policy``."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy, failed: str = "failed") -> DataFrame:
    """For each rule of ``policy``: how many documents fail it, how many fail nothing else, and how many the policy keeps without it.

    The ledger is first counted by its failure bits (2^rules groups at most), so one narrow aggregation serves every
    rule and policy.  An empty ledger gives zeros.
    """
    counted = rows.groupBy(F.col(failed).bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    columns = []
    for name in policy.rules:
        rest = F.col("bits").bitwiseAND(F.lit(policy.mask - BIT[name])) == 0
        hit = F.col("bits").bitwiseAND(F.lit(BIT[name])) != 0
        part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
        columns.append(F.struct(F.lit(policy.version).alias("version"), F.lit(name).alias("rule"), part(hit).alias("failing"), part(hit & rest).alias("only"), part(rest).alias("kept_without")).alias(name))
    return counted.agg(*columns).select(F.explode(F.array(*policy.rules)).alias("r")).select("r.*")
