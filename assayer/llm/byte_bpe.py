"""Byte-level BPE with the ranks of a public tokenizer: pairs are contracted by recursive DuckDB queries in each task, ordered aggregation decodes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import batched

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: Code points that later Unicode versions made letters or numbers, and the tokenizer's own tables do not know as such.
NEW_LETTERS = "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
NEW_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Pieces that a task remembers before it starts anew, characters it works on at a time, and pieces of a long text at a time.
REMEMBERED, CHARS, PIECES = 500_000, 4_000_000, 500_000
#: Pieces of more bytes are contracted at all equal pairs at once.
LONG = 1024
#: Bytes, squared by word, that one recursive query over short pieces takes: its rows hold at most half as many ids.
SQUARES = 50_000_000
#: Rows that one recursive query over long pieces may make.
ROWS = 4_000_000

#: Token-position rows of all words meet the merges; each word's leftmost pair of the least rank is contracted, until no pair has one.
CONTRACT = """
WITH RECURSIVE t AS (
  SELECT w, ids, 0 AS step FROM start
  UNION ALL
  SELECT t.w, list_concat(ids[:(best & 4294967295) - 1], [(best >> 32)::INTEGER], ids[(best & 4294967295) + 2:]), step + 1
  FROM t JOIN (
    SELECT w, min((m::BIGINT << 32) | pos) AS best
    FROM (SELECT w, (unnest(ids[:-2])::BIGINT << 32) | unnest(ids[2:]) AS pair, unnest(range(1, len(ids))) AS pos FROM t) JOIN merges USING (pair) GROUP BY w) AS b ON b.w = t.w
) SELECT w, arg_max(ids, step) AS ids FROM t GROUP BY w ORDER BY w
"""
#: The same for long words, as rows: a step contracts the leftmost pair, and with it every other pair of its rank if no merge of the new token comes before it.
CONTRACT_LONG = """
WITH RECURSIVE t AS (
  SELECT w, pos, id, 0 AS step, false AS done FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN hit THEN m ELSE id END, step + 1, best IS NULL FROM (
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
      SELECT *, coalesce(m = best AND (pos = leftmost OR safe AND row_number() OVER (PARTITION BY w, m = best, i - k ORDER BY pos) % 2 = 1), false) AS hit FROM (
        SELECT *, row_number() OVER (PARTITION BY w, m = best ORDER BY pos) AS k, min(pos) FILTER (m = best) OVER (PARTITION BY w) AS leftmost FROM (
          SELECT *, min(m) OVER (PARTITION BY w) AS best FROM (
            SELECT n.*, m, safe FROM (SELECT w, pos, id, step, lead(id) OVER (PARTITION BY w ORDER BY pos) AS next, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM t WHERE NOT done) AS n
            LEFT JOIN merges ON pair = (id::BIGINT << 32) | next)))))
  WHERE NOT gone AND step < ?
) SELECT w, pos, id, done FROM t WHERE done OR step = ? ORDER BY w, pos
"""
DECODE = "SELECT unhex(string_agg(coalesce(hex, error('no such token')), '' ORDER BY pos)) AS bytes FROM start LEFT JOIN tokens USING (id)"


def _class(ranges: str) -> str:
    return "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split()) + "]"


#: What the public pattern comes to in a text of ASCII alone, which the standard library matches faster.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


class Splitter:
    """Parts a text as the tokenizer's own tables of letters and numbers do: texts with newer ones are few, and take a slower pattern."""

    def __init__(self, pattern: str) -> None:
        self.ascii = re.compile(ASCII) if pattern == public_tokenizers.PATTERN else regex.compile(pattern)
        self.newer = re.compile(_class(NEW_LETTERS + " " + NEW_NUMBERS))
        self.plain = regex.compile(pattern)
        self.exact = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--{_class(NEW_LETTERS)}]").replace(r"\p{N}", rf"[\p{{N}}--{_class(NEW_NUMBERS)}]"), regex.V1)

    def of(self, text: str) -> re.Pattern | regex.Pattern:
        return self.ascii if text.isascii() else self.plain if not self.newer.search(text) else self.exact


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """The tokens of a rank file, each with its id; read by the driver."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """A task's connection with the merge table, and the pieces it has coded."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.ids: dict[str, bytes] = {}
        self.bytes: dict[str, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], "<i4")
        merges = np.array([(a, b, m) for token, m in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None] or np.empty((0, 3)), np.int64)
        # a token is safe if all it can join comes after it: equal pairs then follow one another
        least = np.full(max(ranks.values()) + 1, 1 << 31)
        for side in (0, 1):
            np.minimum.at(least, merges[:, side], merges[:, 2])
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self._put("given", {"pair": merges[:, 0] << 32 | merges[:, 1], "m": merges[:, 2].astype(np.int32), "safe": least[merges[:, 2]] > merges[:, 2]})
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.width = np.zeros(len(least), np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        self._put("given", {"id": np.array(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM given")

    def _put(self, name: str, columns: dict) -> None:
        self.con.register(name, pa.table(columns))

    def _rows(self, query: str, *given) -> pa.Table:
        return self.con.sql(query, params=list(given)).to_arrow_table()

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty) after all contractions."""
        out: list[np.ndarray] = [np.empty(0, "<i4")] * len(words)
        start = [self.single[np.frombuffer(x, np.uint8)] for x in words]
        groups, room = [[]], SQUARES
        for i, x in enumerate(words):
            if len(x) <= LONG:
                if room < len(x) ** 2:
                    groups.append([])
                    room = SQUARES
                groups[-1].append(i)
                room -= len(x) ** 2
        for short in filter(None, groups):
            sizes = np.cumsum([0] + [len(words[i]) for i in short]).astype(np.int32)
            self._put("start", {"w": np.arange(len(short), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([start[i] for i in short]), pa.int32()))})
            found = self._rows(CONTRACT)["ids"].combine_chunks()
            ends, ids = found.offsets.to_numpy(), found.values.to_numpy()
            for n, i in enumerate(short):
                out[i] = ids[ends[n] : ends[n + 1]]
        for i, x in enumerate(words):
            if len(x) > LONG:
                ids, done = start[i], False
                while not done:
                    steps = max(1, ROWS // len(ids))
                    self._put("start", {"w": np.zeros(len(ids), np.int32), "pos": np.arange(len(ids), dtype=np.int64), "id": ids})
                    rows = self._rows(CONTRACT_LONG, steps, steps)
                    ids, done = rows["id"].to_numpy(), bool(rows["done"][0].as_py())
                out[i] = ids
        return out

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of neighbouring stretches of ``ids``, of so many ids each; an unknown id is an error."""
        if not len(ids):
            return [b""] * len(sizes)
        self._put("start", {"id": ids, "pos": np.arange(len(ids), dtype=np.int64)})
        text = self._rows(DECODE)["bytes"][0].as_py()
        ends = np.concatenate([[0], np.cumsum(self.width[ids])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def learn(self, pieces: set[str]) -> None:
        """Codes the pieces that aren't remembered; a piece that is a token is that token."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.bytes = {}, {}
        new = [p for p in pieces if p not in self.ids]
        raw = [p.encode("utf-8") for p in new]
        coded = [self.ranks[x].to_bytes(4, "little") if x in self.ranks else b"" for x in raw]
        parts = [i for i, x in enumerate(coded) if not x]
        for i, ids in zip(parts, self.contract([raw[i] for i in parts])):
            coded[i] = ids.tobytes()
        if new:
            self.ids.update(zip(new, coded))
            self.bytes.update(zip(new, self.decode(np.frombuffer(b"".join(coded), "<i4"), np.array([len(x) // 4 for x in coded]))))

    def code(self, texts: list[str], splitter: Splitter) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of each text; a long text in blocks of pieces."""
        ids, decoded = [bytearray() for _ in texts], [bytearray() for _ in texts]

        def flush(blocks: list[tuple[int, list[str]]]) -> None:
            self.learn(set().union(*(block for _, block in blocks)))
            for i, block in blocks:
                ids[i] += b"".join(map(self.ids.__getitem__, block))
                decoded[i] += b"".join(map(self.bytes.__getitem__, block))

        blocks: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            pattern = splitter.of(text)
            if len(text) <= CHARS:
                blocks.append((i, pattern.findall(text)))
            else:
                for block in batched((m[0] for m in pattern.finditer(text)), PIECES):
                    flush([(i, list(block))])
        flush(blocks)
        return [bytes(x) for x in ids], [bytes(x) for x in decoded]


#: The coder of a Python worker, kept while tasks of the same ranks follow one another.
_KEPT: dict[int, Coder] = {}


def _coder(key: int, ranks: dict[bytes, int]) -> Coder:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Coder(ranks)
    return _KEPT[key]


def _groups(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of neighbours of about ``most`` characters together."""
    at, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text)
        if n >= most:
            yield slice(at, i + 1)
            at, n = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def code_texts(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as token ids and back: ``doc_id, n_tokens, ids, decoded``, one row per input row.

    ``ids`` holds unsigned 32-bit little-endian numbers, ``decoded`` the bytes that the ids stand for.  ``path`` is a rank file
    that the driver reads (its tokens are broadcast, 50,000 short strings), ``pattern`` has no groups and parts a text into pieces, which
    are coded one by one: a piece that is a token is that token; else its bytes are contracted, pair by pair, the least rank first and the
    leftmost of equal ones.  There are no special tokens.

    A null text counts as empty: no tokens, no bytes.  Bytes that aren't UTF-8 are read as U+FFFD.  Rows are independent: repeated rows
    repeat, null ids are carried, an empty table is empty, other columns are ignored.  A text of any length is coded whole, in blocks of
    pieces; a task remembers a bounded number of pieces.  A single piece without a break of very many different letters takes
    time beyond its length, since its contractions follow one another; a run of one character does not.
    """
    ranks = read_ranks(path)
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), hash(tuple(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, splitter = _coder(key, shared.value), Splitter(pattern)
        for batch in batches:
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            for part in _groups(texts, CHARS):
                ids, decoded = coder.code(texts[part], splitter)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def decode_ids(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the bytes of any ids as ``code_texts`` writes them; null or no ids give no bytes, an unknown id is an error."""
    ranks = read_ranks(path)
    shared, key = coded.sparkSession.sparkContext.broadcast(ranks), hash(tuple(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, shared.value)
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            out = coder.decode(np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
