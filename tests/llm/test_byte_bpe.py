"""Byte-level BPE against the public library, over all code points, long runs and whole tables."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from assayer.llm import byte_bpe as B, queries as Q
from test_llm import SCHEMA, SF, documents, odd_texts, tables

RANKS = B.read_ranks()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLITTER = B.Splitter(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def coder():
    return B.Coder(RANKS)


def same(coder, texts):
    ids, decoded = coder.code(texts, SPLITTER)
    for text, a, b in zip(texts, ids, decoded):
        want = LIBRARY.encode_ordinary(text)
        assert list(struct.unpack(f"<{len(a) // 4}I", a)) == want, text[:80]
        assert b == text.encode()


@pytest.mark.parametrize("kind", [r"\p{L}", r"\p{N}", r"\s"])
def test_classes_of_every_code_point(kind):
    """Letters, numbers and spaces are those of the library's tables, for each code point."""
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    one = tiktoken.Encoding("one", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert set(B.Splitter(kind).exact.findall(text)) == set(bytes(one.encode_ordinary(text)).decode())


def test_ascii_is_parted_alike():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(chr(rng.randrange(128)) if rng.random() < 0.5 else rng.choice(" \n'stre19a_") for _ in range(rng.randrange(30)))
        assert SPLITTER.ascii.findall(text) == SPLITTER.plain.findall(text) == SPLITTER.exact.findall(text)


def test_all_code_points(coder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    same(coder, [" ".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}." for c in points[i : i + 2000]) for i in range(0, len(points), 2000)])
    same(coder, ["a\u0558b \u0558\u0558 1\U00012475", "plain é", "\U000323B0"])


def test_random_texts(coder):
    rng = random.Random(2)
    marks = [" ", "  ", "\n", "\n\n ", "\t", "'s", "'LL", "’", "é", "日本語", "한국", "🙂", "1", "２", "½", "the", " The", "ing", "==", "--", "\x00", " ", " ", "\x1c", "<|endoftext|>", "Ω", "ß"]
    same(coder, ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(3000)])
    letters = "abcdefghijklmnopqrstuvwxyz"
    same(coder, ["".join(rng.choices(letters, k=rng.randrange(1, 90))) for _ in range(2000)])
    same(coder, ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 200))) for _ in range(300)])


@pytest.mark.parametrize("rows, long", [(4_000_000, 1024), (4_000_000, 64), (1000, 64)])
def test_long_pieces(coder, monkeypatch, rows, long):
    """Pieces beyond the short way, also when one recursion can't end them."""
    monkeypatch.setattr(B, "ROWS", rows)
    monkeypatch.setattr(B, "LONG", long)
    rng = random.Random(3)
    same(coder, ["a" * 1999, "=" * 513, " " * 777 + "x", "ab" * 400, "aab" * 300, "日本" * 300, "é" * 501, "".join(rng.choices("abcdefghij", k=700)), "".join(rng.choices("the and ing", k=900)).replace(" ", "n")])


def test_a_megabyte_of_one_letter(coder):
    coder.code(["a" * 1_000_000], SPLITTER)


def test_blocks_and_forgetting(monkeypatch):
    monkeypatch.setattr(B, "CHARS", 50)
    monkeypatch.setattr(B, "PIECES", 7)
    monkeypatch.setattr(B, "REMEMBERED", 20)
    monkeypatch.setattr(B, "SQUARES", 100)
    rng = random.Random(4)
    same(B.Coder(RANKS), [" ".join("".join(rng.choices("abcde", k=rng.randrange(1, 6))) for _ in range(rng.randrange(60))) for _ in range(60)])


def test_ids_that_no_text_gives(coder):
    """Any ids decode, also in an order that encoding never makes; an unknown one is an error."""
    rng = random.Random(5)
    ids = [rng.choices(range(len(RANKS)), k=rng.randrange(9)) for _ in range(50)]
    flat = B.np.array([x for y in ids for x in y], "<i4")
    assert coder.decode(flat, B.np.array([len(x) for x in ids])) == [LIBRARY.decode_bytes(x) for x in ids]
    with pytest.raises(Exception):
        coder.decode(B.np.array([len(RANKS)], "<i4"), B.np.array([1]))


def digests(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_rows(spark):
    texts = odd_texts()
    rows = {r.doc_id: r for r in B.code_texts(documents(spark, texts)).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {i: digests(t)[0] for i, t in enumerate(texts)}
    again = {r.doc_id: bytes(r.decoded) for r in B.decode_ids(B.code_texts(documents(spark, texts))).collect()}
    assert again == {i: (t or "").encode() for i, t in enumerate(texts)} == {i: bytes(r.decoded) for i, r in rows.items()}
    assert B.code_texts(spark.createDataFrame([], SCHEMA)).count() == 0 == B.decode_ids(B.code_texts(spark.createDataFrame([], SCHEMA))).count()
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens) for r in B.code_texts(twice).collect()] == [(None, 2)] * 2


@tables
def test_whole_table_as_the_library(spark):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op12_byte_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found == {r.doc_id: digests(r.text) for r in texts}
