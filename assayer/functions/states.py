"""States: text or JSON of any nesting, as flat paths, features, readable text, examples and hashed tokens."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from assayer.functions import text as T

#: Nesting that is followed, elements of a list of objects and of a list of values.
DEPTH, OBJECTS, ITEMS = 8, 20, 30
#: The path of a text state, the widest z-score, how features of other kinds than text begin.
TEXT, WIDEST = "$text", 4.0
#: Fixed values of the hashing tokenizer.
CLS, SEP, MASK, SPECIALS, STEM, VOCABULARY = 1, 2, 3, 4, 6, 16384
MARK = "⟦M⟧"
NOUL_OPTIONS = {"true": "yes, the statement is true", "false": "no, the statement is false"}

FLAT = ArrayType(StructType([StructField(c, StringType()) for c in ("path", "kind", "text")] + [StructField("number", DoubleType()), StructField("items", ArrayType(StringType()))]))


def parsed(state: str) -> Any:
    """The JSON object or array that a state is, else its text."""
    if state.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(state)
        except ValueError:
            pass
    return state


def leaves(node: Any, path: str = "", depth: int = 0) -> Iterator[tuple[str, Any]]:
    """The values of a state under their dotted paths; a list of plain values is one value under ``path[]``."""
    if depth > DEPTH:
        return
    if isinstance(node, dict):
        for key, value in node.items():
            yield from leaves(value, f"{path}.{key}" if path else str(key), depth + 1)
    elif isinstance(node, list) and any(isinstance(v, (dict, list)) for v in node):
        for i, value in enumerate(node[:OBJECTS]):
            yield from leaves(value, f"{path}[{i}]", depth + 1)
    else:
        yield (f"{path}[]" if isinstance(node, list) else path or TEXT), node


def _leaf(path: str, value: Any) -> dict:
    kind = "null" if value is None else {bool: "bool", int: "number", float: "number", list: "list"}.get(type(value), "text")
    plain = str(value).lower() if kind == "bool" else None if kind in ("null", "list") else str(value)
    number = float(value) if kind == "number" else None
    return {"path": path, "kind": kind, "text": plain, "number": number, "items": [str(v) for v in value] if kind == "list" else None}


@F.pandas_udf(FLAT)
def flat(state: pd.Series) -> pd.Series:
    """The leaves of each state in order, the last of a repeated path; null for null.  JSON of unknown shape has no column form, so this is Python."""
    return state.map(lambda s: None if s is None else [_leaf(p, v) for p, v in dict(leaves(parsed(s))).items()])


@F.pandas_udf(StringType())
def canonical(state: pd.Series) -> pd.Series:
    """JSON with sorted keys; text as it is."""
    return state.map(lambda s: None if s is None else s if isinstance(x := parsed(s), str) else json.dumps(x, ensure_ascii=False, sort_keys=True))


def state_hash(state: Column) -> Column:
    """States that differ only in the order of keys or in outer white space have one hash."""
    return T.state_hash(canonical(state))


def _each(flat_: Column, of) -> Column:
    return F.array_distinct(F.flatten(F.transform(flat_, of)))


def categories(flat_: Column) -> Column:
    """``k:path=value`` of booleans, short texts and list items."""
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        named = lambda v: F.concat(F.lit("k:"), x["path"], F.lit("="), v)
        short = F.trim(x["text"])
        return (
            F.when(x["kind"] == "bool", F.array(named(x["text"])))
            .when(x["kind"] == "list", F.transform(F.slice(x["items"], 1, ITEMS), lambda v: named(T.fold(v))))
            .when((x["kind"] == "text") & (x["path"] != TEXT) & (short != "") & T.is_short(short), F.array(named(T.fold(short))))
            .otherwise(none)
        )

    return _each(flat_, of)


def words(flat_: Column) -> Column:
    """Distinct text features of all texts, each tokenised by itself."""
    texts = F.filter(flat_, lambda x: x["kind"] == "text")
    return _each(texts, lambda x: T.token_features(T.tokens(x["text"])))


def numbers(flat_: Column) -> Column:
    """``path, number`` of the finite numbers."""
    found = F.filter(flat_, lambda x: (x["kind"] == "number") & ~F.isnan(x["number"]) & (F.abs(x["number"]) < math.inf))
    return F.transform(found, lambda x: F.struct(x["path"].alias("path"), x["number"].alias("number")))


def number_stats(labelled: DataFrame, flat_col: str = "flat") -> DataFrame:
    """``path, n, mean, sd`` over labelled states only: unlabelled traffic never moves the scale."""
    rows = labelled.select(F.explode(numbers(F.col(flat_col))).alias("x")).select("x.*")
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.avg("number").alias("mean"), F.stddev_samp("number").alias("sd"))


def sparse(states: DataFrame, stats: DataFrame, flat_col: str = "flat", most_paths: int = 100_000) -> DataFrame:
    """``states`` with ``features``, a map: bias, text features of one unit together, categories, and numbers by z-score.

    The statistics are one row for each numeric path; more than ``most_paths`` raise ValueError, so what each task holds is bounded.
    """
    rows = stats.where("n >= 2 and sd > 1e-9").limit(most_paths + 1)
    if rows.count() > most_paths:
        raise ValueError(f"more than {most_paths} numeric paths")
    scale = rows.agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("mean", "sd")))).alias("_stats"))  # one row
    found = states.join(F.broadcast(scale)).withColumns({"_w": words(F.col(flat_col)), "_k": categories(F.col(flat_col)), "_n": F.filter(numbers(F.col(flat_col)), lambda x: F.map_contains_key("_stats", x["path"]))})

    def z(x: Column) -> Column:
        s = F.element_at("_stats", x["path"])
        return F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), (x["number"] - s["mean"]) / s["sd"]))

    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    one = 1 / F.sqrt(F.size("_w"))
    entries = F.concat(F.array(pair(F.lit("bias"), F.lit(1.0))), F.transform("_w", lambda w: pair(w, one)), F.transform("_k", lambda k: pair(k, F.lit(1.0))), F.transform("_n", lambda x: pair(F.concat(F.lit("n:"), x["path"]), z(x))))
    return found.withColumn("features", F.map_from_entries(entries)).drop("_stats", "_w", "_k", "_n")


def norm(features: Column) -> Column:
    """The length of a sparse vector; 1 for an empty one."""
    length = F.sqrt(F.aggregate(F.map_values(features), F.lit(0.0), lambda a, v: a + v * v))
    return F.when(length > 0, length).otherwise(1.0)


def readable(flat_: Column, limit: int | None = None) -> Column:
    """``path: value | path: value``, nulls left out; text as it is.  ``limit`` cuts it to so many characters."""
    value = lambda x: F.when(x["kind"] == "list", F.array_join(x["items"], ", ")).when(x["kind"] == "bool", F.initcap(x["text"])).otherwise(x["text"])
    parts = F.transform(F.filter(flat_, lambda x: x["kind"] != "null"), lambda x: F.when(x["path"] == TEXT, value(x)).otherwise(F.concat(x["path"], F.lit(": "), value(x))))
    whole = F.array_join(parts, " | ")
    return F.substring(whole, 1, limit) if limit else whole


def question_text(kind: Column, instructions: Column, options: Column) -> Column:
    """The question, then each of ``options`` (name, description) behind a mark; a noul's have descriptions of their own."""
    own = F.create_map(*(F.lit(x) for pair in NOUL_OPTIONS.items() for x in pair))
    blank = lambda x: F.coalesce(x, F.lit(""))

    def option(o: Column) -> Column:
        said = F.when((blank(o["description"]) == "") & (kind == "noul"), blank(F.element_at(own, o["name"]))).otherwise(blank(o["description"]))
        return F.concat(F.lit(MARK + " "), o["name"], F.when(said != "", F.concat(F.lit(": "), said)).otherwise(""))

    return F.array_join(F.concat(F.array(F.trim(F.concat(kind, F.lit(": "), blank(instructions)))), F.transform(options, option)), " ")


def token_ids(text: Column, vocabulary: int = VOCABULARY) -> Column:
    """Hashed tokens: numbers by quarter decades, words by their first letters."""
    found = F.regexp_extract_all(T.fold(text), F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)?|[\p{L}\p{N}_]+"), F.lit(0))

    def one(t: Column) -> Column:
        v = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
        size = F.when(v > 0, F.rint(F.log10(v) * 4).cast("int").cast("string")).otherwise("zero")
        name = F.when(t.rlike(r"^\p{Nd}"), F.concat(F.lit("#num"), size)).otherwise(F.substring(t, 1, STEM))
        return (SPECIALS + F.crc32(name.cast("binary")) % (vocabulary - SPECIALS)).cast("int")

    return F.transform(found, one)


def encoded(question: Column, state: Column, most: int, vocabulary: int = VOCABULARY) -> Column:
    """Ids of the question with its marks, then of the state, of which what is over ``most`` is cut; null if the question alone is too long."""
    chunks = F.split(question, MARK, -1)
    head = F.flatten(F.transform(chunks, lambda c, i: F.concat(F.when(i > 0, F.array(F.lit(MASK))).otherwise(F.array().cast("array<int>")), token_ids(c, vocabulary))))
    first = F.concat(F.array(F.lit(CLS)), head, F.array(F.lit(SEP)))
    rest = F.slice(token_ids(state, vocabulary), F.lit(1), F.greatest(F.lit(most) - F.size(first) - 1, F.lit(0)))
    return F.when(F.size(first) <= most - 8, F.concat(first, rest, F.array(F.lit(SEP))))


def _present(name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNotNull() & (c.cast("string") != "")


def _json(name: str, kind: str) -> Column:
    """A column's value as JSON: numbers as numbers, but not those that begin with a zero."""
    c = F.col(f"`{name}`")
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    if kind in ("boolean", "bigint", "int", "smallint", "tinyint"):
        return c.cast("string")
    text = F.trim(c.cast("string"))
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.when(T.to_number(text).isNotNull() & ~text.rlike("^0[0-9]"), T.to_number(text).cast("string")).otherwise(quoted)


def examples(rows: DataFrame, answer: str, state_cols: Sequence[str], mode: str = "auto") -> DataFrame:
    """``rows`` that have an answer and a state, with ``state`` and ``answer``.

    ``text`` joins the columns' texts, ``json`` makes an object of them; ``auto`` keeps one text column as text and one
    nested column as it is.  Blank and null values are left out.
    """
    kinds = dict(rows.dtypes)
    parts = [F.when(_present(c), F.col(f"`{c}`").cast("string")) for c in state_cols if not kinds[c].startswith(("array", "struct", "map"))]
    text = F.concat_ws(" \n", *parts) if parts else F.lit("")
    fields = F.concat_ws(", ", *(F.when(_present(c) if not kinds[c].startswith(("array", "struct", "map")) else F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'"{c}": '), _json(c, kinds[c]))) for c in state_cols))
    whole = F.when(fields != "", F.concat(F.lit("{"), fields, F.lit("}")))
    if mode == "text":
        state = text
    elif mode == "auto" and len(state_cols) == 1 and kinds[state_cols[0]].startswith(("array", "struct", "map")):
        state = F.to_json(F.col(f"`{state_cols[0]}`"))
    elif mode == "auto" and len(state_cols) == 1 and kinds[state_cols[0]] == "string":
        state = F.when(T.to_number(F.col(f"`{state_cols[0]}`")).isNull(), text).otherwise(whole)
    else:
        state = whole
    found = rows.where(_present(answer)).withColumns({"state": state, "answer": F.col(f"`{answer}`").cast("string")})
    return found.where("state is not null and state <> '' and state <> '{}'")
