"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TOKEN = re.compile(r"([^\W\d_]+)|(\d+)|([^\w\s]+|_+)")
#: Feature hashes fall into 2^18 buckets.
BUCKETS = 1 << 18
#: Longer words also count by their first so many letters.
STEMS = (4, 6, 8)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text: the words it holds, how they begin, and how often (in steps of a doubling) each run of symbols, capital words, digits and repeated words and lines come."""
    text = text or ""
    words, symbols, capitals, digits = {}, {}, 0, 0
    for word, number, other in TOKEN.findall(text):
        if word:
            low = word.lower()
            words[low] = words.get(low, 0) + 1
            capitals += len(word) > 1 and word.isupper()
        elif number:
            digits += 1
        else:
            symbols[other] = symbols.get(other, 0) + 1
    n = sum(words.values())
    step = lambda part: int(1024 * part / max(1, n)).bit_length()
    lines = [x for x in text.split("\n") if x.strip()]
    shape = {"capitals": capitals, "digits": digits, "symbols": sum(symbols.values()), "repeats": n - len(words), "lines": len(lines), "repeated lines": len(lines) - len(set(lines))}
    starts = {w[:m] for w in words for m in STEMS if len(w) > m}
    names = [*(f"w {w}" for w in words), *(f"p {w}" for w in starts), *(f"s {s} {step(c)}" for s, c in symbols.items()), *(f"f {k} {step(v)}" for k, v in shape.items()), f"n {n.bit_length()}"]
    return np.unique(np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names), np.int32, len(names)))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= j | x) = logistic(cuts[j] - weights . x): one weight for each bucket, ordered cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int, penalty: float = 1e-3, least_rows: int = 8, epochs: int = 100, batch: int = 256, rate: float = 0.05) -> OrdinalModel:
    """Adam on the penalised likelihood, in batches of shuffled rows, at a falling rate; buckets in fewer than ``least_rows`` rows keep weight 0.

    Without rows every grade is equally likely.  The cuts are a first value and log gaps, so they stay ordered.
    """
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not len(rows):
        p = np.arange(1, levels) / levels
        return OrdinalModel(weights, np.log(p / (1 - p)))
    used = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= least_rows
    place = np.cumsum(used) - 1
    rows = [place[r[used[r]]] for r in rows]
    k = int(used.sum())
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(k), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    rng, steps = np.random.default_rng(7), epochs * -(-len(rows) // batch)
    picks = (order[at : at + batch] for order in (rng.permutation(len(rows)) for _ in range(epochs)) for at in range(0, len(rows), batch))
    for t, pick in enumerate(picks, 1):
        g, n = grades[pick], len(pick)
        flat = np.concatenate([rows[i] for i in pick])
        row_of = np.repeat(np.arange(n), [len(rows[i]) for i in pick])
        w, gaps = theta[:k], np.exp(theta[k + 1 :])
        cuts = theta[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row_of, w[flat], minlength=n)
        upper = np.where(g < levels - 1, logistic(cuts[np.minimum(g, levels - 2)] - score), 1.0)
        lower = np.where(g > 0, logistic(cuts[np.maximum(g - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        slope = np.bincount(flat, (du - dl)[row_of], minlength=k)  # of the loss, by weight
        by_cut = np.bincount(np.maximum(g - 1, 0), dl, minlength=levels - 1) - np.bincount(np.minimum(g, levels - 2), np.where(g < levels - 1, du, 0), minlength=levels - 1)
        up = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([slope + penalty * w, up[:1], up[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta -= rate * (1 - (t - 1) / steps) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights[np.flatnonzero(used)] = theta[:k]
    return OrdinalModel(weights, theta[k] + np.concatenate([[0.0], np.cumsum(np.exp(theta[k + 1 :]))]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["grade", "x"])


def train(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8_000) -> OrdinalModel:
    """Fit on a bounded sample of the rated documents: about ``sample_rows``, 1.25 times that at most, by a hash of the id.

    ``ratings`` has ``id_col`` and the columns of ``grade``, an int from 0 to ``levels`` - 1; rows with a null id or grade,
    or without a document, are left out.  Of several ratings of an id the lowest counts, of several texts the first in order;
    so reruns learn the same.
    """
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where(f"id is not null and grade between 0 and {levels - 1}").groupBy("id").agg(F.min("grade").alias("grade"))
    count = rated.count()
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    picked = rated.where(h < int(min(1.0, sample_rows / max(1, count)) * (1 << 30))).orderBy(h, "id").limit(sample_rows * 5 // 4)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = text.join(F.broadcast(picked), "id").groupBy("id", "grade").agg(F.min("text").alias("text")).select("grade", "text").mapInArrow(_featurise, "grade int, x binary").collect()
    found.sort(key=lambda r: (r.grade, r.x))
    return fit_ordinal([np.frombuffer(r.x, np.int32) for r in found], np.array([r.grade for r in found], dtype=np.int64), levels)


def _score(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.weights[features(t)].sum(dtype=np.float64) for t in batch.column(1).to_pylist()], dtype=np.float64)
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "p_top"])

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Expected grade, probability of the highest grade, and ``kept``: whether that is ``least`` or more.

    One row per input row: ``doc_id, expected_grade, p_top, kept``.  Null counts as an empty text, which has features of its
    own (no words).  Rows are independent: repeated rows and null ids are carried, an empty table is empty, other columns are ignored.
    The model's weights (1 MB) go with the tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, expected_grade double, p_top double").withColumn("kept", F.col("p_top") >= least)


def _select(model: OrdinalModel, place: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.weights[features(t)].sum(dtype=np.float64) for t in batch.column(place).to_pylist()], dtype=np.float64)
            yield batch.filter(pa.array(model.tails(score)[:, -1] >= least))

    return run


def select_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``grade_documents`` keeps, with all their columns; one pass, nothing is shuffled."""
    return docs.mapInArrow(_select(model, docs.columns.index(text_col), least), docs.schema)


def rating_grade() -> Column:
    """The grade of a ``labels`` row: 0 toxic, 1 of low quality, 2 good; null where either flag is null."""
    return F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
