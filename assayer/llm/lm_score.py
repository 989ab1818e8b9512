"""Language-model scores from a log-frequency Bloom filter of bigram and trigram counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.tables import hashed, mixed, words, written

#: The end of a text is a token; it also stands before a text's first word.
END = np.uint64(0x9E3779B97F4A7C15)
#: The filter has so many bits for each training token, in chunks of 1 MB.
BITS_PER_TOKEN, CHUNK_BITS = 10, 1 << 23
#: A filter of up to so many chunks is broadcast; to a larger one the probes are sent, chunk by chunk.
BROADCAST_CHUNKS = 32
#: Each level of a count sets so many bits.
PROBES = 3
#: Exact counts of the most frequent words, so many at most, are broadcast; the others are joined.
HEAD_WORDS = 1_000_000
#: Texts are taken together in units of about so many tokens, and the counts of so many units are added up at a time.
UNIT_TOKENS, FAN_IN = 1_000_000, 4096
TOKENS = "unit long, ids array<long>, lengths array<int>, training array<boolean>, vocabulary binary, codes binary"
GRAMS = "chunk long, unit long, grams binary, counts binary"
ANSWERS = "unit long, chunk long, levels binary, token long, c long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """An array in few bytes: its lowest bytes, its next ones, and so on, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text, then the end."""
    return np.append(hashed(words(text)), END)


class Unit:
    """The tokens of some whole texts, one after another: codes into a vocabulary of their hashes."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        self.vocabulary, self.codes, self.lengths = vocabulary, codes, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    @classmethod
    def of(cls, row: dict) -> Unit:
        return cls(np.frombuffer(row["vocabulary"], np.uint64), unpacked(row["codes"], np.uint32), np.array(row["lengths"], dtype=np.int64))

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """``values`` (one for each token) of the token before; ``first`` at a text's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each token with the one before it, and with the two before it."""
        now = self.vocabulary[self.codes]
        last = self.before(now, END)
        two = mixed(now + mixed(last * np.uint64(0xD6E8FEB86659FD93)))
        return two, mixed(two + mixed(self.before(last, END) * np.uint64(0xA5CB9243F3A8C6D7)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each text."""
        return np.add.reduceat(values, self.starts)


def levels(counts: np.ndarray) -> np.ndarray:
    """The quantised logarithm of a count: 1 for 1, two more for each doubling."""
    return (2 * np.log2(counts) + 1e-9).astype(np.int64) + 1


def least_count(level: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 at level 0: so an estimate is never above the true count but for false positives."""
    return np.where(level > 0, np.ceil(np.exp2((level - 1) / 2) - 1e-6), 0.0)


def most_count(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level, 0 at level 0."""
    return np.where(level > 0, least_count(level + 1) - 1, 0.0)


def located(h: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of each hash, and what names it there: its place in the chunk's range.  Both rise with the hash."""
    n, low = np.uint64(chunks), np.uint64(0xFFFFFFFF)
    at = (h >> np.uint64(32)) * n + ((h & low) * n >> np.uint64(32))
    return (at >> np.uint64(32)).astype(np.int64), (at & low).astype(np.uint32)


def places(grams: np.ndarray, level: int, probe: int) -> np.ndarray:
    """The bit within its chunk that a level and probe of an n-gram have."""
    salt = np.uint64((level * 64 + probe) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF)
    return (mixed(grams.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + salt) & np.uint64(CHUNK_BITS - 1)).astype(np.int64)


def filter_bits(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of one chunk: an n-gram of level q is inserted at levels 1 to q."""
    bits, top = np.zeros(CHUNK_BITS, dtype=bool), levels(counts)
    for level in range(1, int(top.max(initial=0)) + 1):
        for probe in range(PROBES):
            bits[places(grams[top >= level], level, probe)] = True
    return np.packbits(bits, bitorder="little")


def probed(bits: np.ndarray, base: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The level of each n-gram: probes go up from level 1 until one isn't a member.  ``base`` is its chunk's first bit."""
    out = np.zeros(len(grams), dtype=np.uint8)
    alive, level = np.arange(len(grams)), 1
    while len(alive):
        for probe in range(PROBES):
            at = base[alive] + places(grams[alive], level, probe)
            alive = alive[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out[alive] = level
        level += 1
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, training, parts, number = [], [], [], TaskContext.get().partitionId() << 32

    def close() -> pa.RecordBatch:
        vocabulary, codes = np.unique(np.concatenate(parts), return_inverse=True)
        order = np.argsort(-np.bincount(codes), kind="stable")  # frequent words have small codes
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        vocabulary, codes = vocabulary[order], place[codes].astype(np.uint32)
        cols = [[number], [ids], [[len(p) for p in parts]], [training], [vocabulary.tobytes()], [packed(codes)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["unit", "ids", "lengths", "training", "vocabulary", "codes"])

    size = 0
    for batch in batches:
        for doc_id, text, known in zip(*(c.to_pylist() for c in batch.columns)):
            parts.append(tokens(text)), ids.append(doc_id), training.append(known)
            size += len(parts[-1])
            if size >= UNIT_TOKENS:
                yield close()
                ids, training, parts, number, size = [], [], [], number + 1, 0
    if parts:
        yield close()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        unit = Unit.of(row)
        counts = np.bincount(unit.codes[np.repeat(row["training"], unit.lengths)], minlength=len(unit.vocabulary))
        used = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(unit.vocabulary[used].view(np.int64)), pa.array(counts[used].astype(np.int64))], ["token", "c"])


def _gram_counts(chunks: int, all_: bool):
    """The different n-grams of each unit by chunk, in order of their hashes, and how often the training texts have them; with
    ``all_`` also those that none has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            unit = Unit.of(row)
            known = np.repeat(row["training"], unit.lengths)
            two, three = unit.grams()
            if not all_:
                two, three, known = two[known], three[known], known[known]
            values, where = np.unique(np.concatenate([two, three]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([known, known]), minlength=len(values)).astype(np.uint64)
            chunk, grams = located(values, chunks)
            bounds = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1)) if len(chunk) else np.zeros(1, dtype=np.int64)
            spans = list(zip(bounds, bounds[1:]))
            cols = [chunk[bounds[:-1]], np.full(len(spans), row["unit"]), [packed(np.diff(grams[a:b], prepend=np.uint32(0))) for a, b in spans], [packed(counts[a:b]) for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "unit", "grams", "counts"])

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of a chunk, their counts, and the place of each row's among them with the rows' lengths."""
    parts = [np.cumsum(unpacked(x, np.uint32), dtype=np.uint32) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([unpacked(x, np.uint64) for x in table.column("counts").to_pylist()])
    values, where = np.unique(np.concatenate(parts), return_inverse=True)
    return values, np.bincount(where, counts, minlength=len(values)), where, np.array([len(p) for p in parts])


def _combine(table: pa.Table) -> pa.Table:
    values, counts, _, _ = _added(table)
    return pa.table({"chunk": table.column("chunk")[:1], "unit": table.column("unit")[:1], "grams": pa.array([packed(np.diff(values, prepend=np.uint32(0)))], pa.binary()), "counts": pa.array([packed(counts.astype(np.uint64))], pa.binary())})


def _build(table: pa.Table) -> pa.Table:
    values, counts, _, _ = _added(table)
    bits = filter_bits(values[counts > 0], counts[counts > 0])
    return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """Builds a chunk and probes it with the n-grams of all units: their levels go back to the units."""
    values, counts, where, lengths = _added(table)
    bits = filter_bits(values[counts > 0], counts[counts > 0])
    found = probed(bits, np.zeros(len(values), dtype=np.int64), values)[where]
    parts = np.split(found, np.cumsum(lengths)[:-1])
    return pa.table({"unit": table.column("unit"), "chunk": table.column("chunk"), "levels": pa.array([packed(p) for p in parts], pa.binary())}).append_column("token", pa.nulls(len(parts), pa.int64())).append_column("c", pa.nulls(len(parts), pa.int64()))


class Head:
    """Exact counts of the frequent words."""

    def __init__(self, table: pa.Table) -> None:
        words_, counts = table.column("token").to_numpy().view(np.uint64), table.column("c").to_numpy()
        order = np.argsort(words_)
        self.words, self.counts = words_[order], counts[order]

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """The count of each word, 0 outside the head."""
        if not len(self.words):
            return np.zeros(len(found), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        return np.where(self.words[at] == found, self.counts[at], 0)


def _rare(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own = np.frombuffer(row["vocabulary"], np.uint64)
            own = own[head.value(own) == 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["unit"]] * len(own), pa.int64()), pa.array(own)], ["unit", "token"])

    return run


class Model:
    """Word counts, the mass of all words, and how much the shorter history counts."""

    def __init__(self, head, mass: float, prior: float, longer: float) -> None:
        self.head, self.mass, self.prior, self.longer = head, mass, prior, longer

    def scores(self, row: dict, level_of) -> pa.RecordBatch:
        """The rows of a unit's texts; ``level_of`` gives the levels of its different n-grams in order of their hashes."""
        unit = Unit.of(row)
        known = self.head.value(unit.vocabulary)
        if row.get("rare"):
            order = np.argsort(unit.vocabulary)
            at = order[np.searchsorted(unit.vocabulary, np.array([r["token"] for r in row["rare"]], dtype=np.int64).view(np.uint64), sorter=order)]
            known[at] = [r["c"] for r in row["rare"]]
        end = int(known[unit.vocabulary == END][0])  # each text has an end
        c = known[unit.codes]
        history = unit.before(c, end).astype(float)
        two, three = unit.grams()
        values, where = np.unique(np.concatenate([two, three]), return_inverse=True)
        found = level_of(values)[where].astype(np.int64)
        level2, level3 = found[: len(two)], found[len(two) :]
        one = (c + 0.5) / self.mass
        pair = (np.minimum(least_count(level2), history) + self.prior * one) / (history + self.prior)
        both = np.minimum(unit.before(most_count(level2), end), history)
        triple = (np.minimum(least_count(level3), both) + self.longer * pair) / (both + self.longer)
        sums = [unit.sums((c > 0).astype(np.int64)), unit.sums(np.log10(one)), unit.sums(np.log10(triple))]
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(unit.lengths), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _score_here(model: Model, segment, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(segment.value, dtype=np.uint8)
        for row in _rows(batches):

            def level_of(h: np.ndarray) -> np.ndarray:
                chunk, grams = located(h, chunks)
                return probed(bits, chunk * CHUNK_BITS, grams)

            yield model.scores(row, level_of)

    return run


def _score_answered(model: Model):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rare = answers.filter(pa.compute.is_valid(answers["token"])).select(["token", "c"]).to_pylist()
        found = np.concatenate([unpacked(x, np.uint8) for x in answers.filter(pa.compute.is_null(answers["token"])).sort_by("chunk")["levels"].to_pylist()])
        return pa.Table.from_batches([model.scores(texts.to_pylist()[0] | {"rare": rare}, lambda h: found)])

    return run


def _by_chunk(rows: DataFrame, chunks: int) -> DataFrame:
    """Dealt by chunk, few to a task however many there are."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks // 8))
    return rows.repartition(n, "chunk").groupBy("chunk")


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = 500.0, longer: float = 20.0) -> DataFrame:
    """log10 probabilities of whole texts under a unigram model and a smoothed trigram model of the ``training`` rows.

    Tokens are lower-cased words, then one end.  The unigram model gives a token (c + 0.5) / (N + 0.5 (V + 1)).  The bigram
    model gives it (b + prior * unigram) / (h + prior), b the bigram's count and h that of the word before, however
    rare; the trigram model (t + longer * bigram) / (g + longer), t the trigram's count and g that of the two words before.
    b, t and g are read from a log-frequency Bloom filter: an n-gram of quantised log count q was inserted at levels 1 to
    q, and membership is probed from 1 upwards.  Counts are rounded down, g up, so that a history's
    probabilities sum to one at most but for false positives.

    Texts are tokenised once, into a written table of units of about ``UNIT_TOKENS``.  The filter has ``BITS_PER_TOKEN``
    bits for each training token, so it grows with the corpus; each chunk is built where the counts of its n-grams meet.  Up to
    ``BROADCAST_CHUNKS`` chunks are broadcast and probed in place.  A larger filter stays dealt out: the different n-grams of each
    unit go to the chunk that holds their bits, and their levels come back to the unit.  Both ways probe the same bits, so
    scores don't depend on them, and each byte of text costs the same work at any size.
    Counts of the ``HEAD_WORDS`` most frequent words are broadcast; a unit's other words are joined with the table of all counts.

    One row per input row: ``doc_id, n_tokens, n_known`` (tokens seen in training), ``train_tokens, base_score, score``.  A
    null text is an empty one: its end only.  A row whose ``training`` is null is learnt from.  Repeated rows count and score each.
    With no training rows every token has probability 1.  Other columns are ignored.  A text is held whole by a task, with its n-grams.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    spark = docs.sparkSession
    units = written(rows.mapInArrow(_units, TOKENS), "units", compression="zstd", maxRecordsPerFile=8)  # so few that a reader holds them
    counts = written(units.mapInArrow(_word_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_size = sorted(counts.groupBy(F.floor(F.log2("c")).alias("e")).count().collect(), reverse=True)
    least, room = 1 << 62, HEAD_WORDS
    for e, size in by_size:
        room -= size
        if room < 0:
            break
        least = 1 << e
    head = spark.sparkContext.broadcast(Head(counts.where(F.col("c") >= least).toArrow()))
    model = Model(head, n + 0.5 * (v + 1), prior, longer)
    texts, rare = units.drop("training"), None
    if v > HEAD_WORDS:  # a word outside the head is of few texts, so it is no hot key
        rare = units.mapInArrow(_rare(head), "unit long, token long").join(counts, "token")

    chunks, count = max(1, -(-n * BITS_PER_TOKEN // CHUNK_BITS)), units.count()
    if chunks <= BROADCAST_CHUNKS:
        grams, parts = units.mapInArrow(_gram_counts(chunks, False), GRAMS), -(-count // FAN_IN)
        if parts > 1:
            grams = grams.groupBy("chunk", F.pmod(F.xxhash64("unit"), F.lit(parts))).applyInArrow(_combine, GRAMS)
        filters = _by_chunk(grams, chunks).applyInArrow(_build, "chunk long, bits binary").toArrow()
        bits = np.zeros((chunks, CHUNK_BITS // 8), dtype=np.uint8)
        for chunk, value in zip(filters.column("chunk").to_pylist(), filters.column("bits")):
            bits[chunk] = np.frombuffer(value.as_buffer(), np.uint8)
        if rare is not None:
            texts = texts.join(rare.groupBy("unit").agg(F.collect_list(F.struct("token", "c")).alias("rare")), "unit", "left")
        out = texts.mapInArrow(_score_here(model, spark.sparkContext.broadcast(bits.tobytes()), chunks), SCORES)
    else:
        answers = _by_chunk(units.mapInArrow(_gram_counts(chunks, True), GRAMS), chunks).applyInArrow(_answer, ANSWERS)
        if rare is not None:
            answers = answers.unionByName(rare, allowMissingColumns=True)
        few = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 4))  # units to a task
        out = texts.repartition(few, "unit").groupBy("unit").cogroup(answers.repartition(few, "unit").groupBy("unit")).applyInArrow(_score_answered(model), SCORES)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
