"""Sums over hashed features by weights of one pass: features are dealt in blocks of texts, each once a block, to the task that learns its weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.operators.learners import ACC_CAP, RATE

#: Texts of a block at most, and features.
BLOCK, MOST = 4_096, 4_000_000
DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("slopes", pa.list_(pa.float64())), ("features", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Blocks of ``kind, id, slopes, fs``, cut in as many parts as tasks by the hashes: different features, how many texts have each, and which."""

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, lists, kind = len(rows), rows.column("fs"), rows.column("kind")[0].as_py()
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(flat)
        by = flat[order]
        first = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else order
        begins, owners = np.append(first, len(by)), np.repeat(np.arange(n, dtype=np.uint16), sizes)[order]
        features, counts = by[first], np.diff(begins).astype(np.uint16)
        cuts = np.searchsorted(((features >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32), np.arange(tasks + 1, dtype=np.uint64))
        parts = [p for p in range(tasks) if p == 0 or cuts[p] < cuts[p + 1]]  # the first part tells of every text
        each = {"ids": rows.column("id").to_pylist() if kind else [], "sizes": sizes.tolist(), "slopes": rows.column("slopes").flatten().to_pylist()}
        a, b = (np.array([cuts[p + i] for p in parts]) for i in (0, 1))
        columns = [pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int32()), *(pa.repeat(pa.scalar(x, DEALT.field(c).type), len(parts)) for c, x in each.items())]
        columns += [pa.array([x[i:j].tobytes() for i, j in zip(at, to)], pa.binary()) for x, at, to in ((features, a, b), (counts, a, b), (owners, begins[a], begins[b]))]
        return pa.RecordBatch.from_arrays(columns, schema=DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, a = np.cumsum(np.diff(batch.column("fs").offsets.to_numpy()).astype(np.int64)), 0
            while a < len(upto):
                b = min(max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MOST, side="right"))), a + BLOCK)
                yield block(batch.slice(a, b - a))
                a = b

    kinds = "part int, kind int, ids array<long>, sizes array<int>, slopes array<double>, features binary, counts binary, owners binary"
    return rows.select("kind", "id", "slopes", "fs").mapInArrow(run, kinds)


def hashed_sums(features: DataFrame, examples: DataFrame, slopes: int, tasks: int, least: float = 0.0) -> DataFrame:
    """``id, size, n, known, z0, z1 ...``: a row for each text and part of the features, to be summed.

    ``features`` has ``id, fs``, ``examples`` has ``slopes, fs`` (an array of so many, and a text's different hashes).  A feature's weights are those of
    ``learners.first_weights``, each text's features sharing one unit; ``z`` sums weights times a feature's value, ``n`` counts a part's
    features of a text of ``size``, ``known`` those with a weight of ``least`` or more.  A text without features has a row as well.

    A block of texts is dealt as its different features, two bytes for each text that has one.  A task holds the weights of its part
    and no text's features, which stream past: the caller deals them over so many tasks that it can.
    """

    def arrays(row: pa.RecordBatch, i: int) -> list[np.ndarray]:
        return [np.frombuffer(row.column(c)[i].as_buffer(), kind) for c, kind in (("features", np.uint64), ("counts", np.uint16), ("owners", np.uint16))]

    def summed(f: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(f, kind="stable")
        first = np.flatnonzero(np.append(True, f[order][1:] != f[order][:-1]))
        return f[order][first], *(np.add.reduceat(s[order], first, axis=0) for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, weights = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                (f, counts, owners), sizes = arrays(batch, i), np.asarray(batch.column("sizes")[i].values)
                unit = 1 / np.sqrt(np.maximum(sizes, 1))
                if batch.column("kind")[i].as_py() == 0:
                    if len(f):
                        g = (np.asarray(batch.column("slopes")[i].values).reshape(-1, slopes) * unit[:, None])[owners]
                        first = np.cumsum(counts, dtype=np.int64) - counts
                        learnt.append((f, np.add.reduceat(g, first, axis=0), np.add.reduceat(g * g, first, axis=0)))
                    continue
                if weights is None:
                    none = (np.empty(0, np.uint64), *[np.empty((0, slopes))] * 2)
                    f_, g, q = summed(*(np.concatenate(x) for x in zip(*learnt))) if learnt else none
                    learnt = []
                    weights = f_, -RATE * g / (np.sqrt(np.minimum(ACC_CAP, q)) + 1e-8)
                    told = (np.abs(weights[1]) >= least).any(axis=1)
                names, w = weights
                n, ids = len(sizes), np.asarray(batch.column("ids")[i].values)
                have = np.bincount(owners, minlength=n)
                known, z = np.zeros(n), np.zeros((n, slopes))
                if len(names) and len(f):
                    at = np.minimum(np.searchsorted(names, f), len(names) - 1)
                    met = names[at] == f
                    known = np.bincount(owners, np.repeat((met & told[at]).astype(float), counts), n)
                    for j in range(slopes):
                        z[:, j] = np.bincount(owners, np.repeat(np.where(met, w[at, j], 0.0), counts), n) * unit
                some = slice(None) if batch.column("part")[i].as_py() == 0 else have > 0
                out = [ids[some], sizes[some], have[some].astype(np.int32), known[some].astype(np.int32), *z[some].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in out], ["id", "size", "n", "known", *(f"z{j}" for j in range(slopes))])

    empty = F.array().cast("array<double>")
    rows = examples.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "slopes", "fs")
    texts = features.select(F.lit(1).alias("kind"), "id", empty.alias("slopes"), "fs")
    dealt = _dealt(rows, tasks).union(_dealt(texts, tasks)).repartitionById(tasks, F.col("part")).sortWithinPartitions("kind")
    return dealt.mapInArrow(run, "id long, size int, n int, known int" + "".join(f", z{j} double" for j in range(slopes)))
