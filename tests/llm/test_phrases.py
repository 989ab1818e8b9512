"""Phrase collocations against a plain reading, with any stretch and filter, and on odd rows."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from assayer.llm import phrases as P, queries as Q
import oracle
from test_llm import SCHEMA, SF, documents, odd_texts, tables


def by_brute_force(rows, max_n, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            score, k = min((int(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and b >= a and inside(q) for q, b in many.items()):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_rows():
    rng = random.Random(4)
    words = ["ab", "cd", "Ef", "gh", "é", " x", "iİ", "#", "'"] + [f"w{i}" for i in range(30)]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "\x0b", "! "]
    said = ["ab cd ef gh w1 w2", "Ab, cd", "w3 w3 w3 w3 w3 w3", "é  x é"]
    texts = ["".join(x for _ in range(rng.randrange(60)) for x in (rng.choice(said) if rng.random() < 0.15 else rng.choice(words), rng.choice(glue))) for _ in range(300)]
    return [(rng.choice(["en", "en", "de", None]), t) for t in texts] + [("en", "w5 w6 " * 3000), ("xx", "lone words"), (None, None), ("de", ""), ("en", "w9")]


@pytest.mark.parametrize("least, top, stretch, bits", [(5, 2000, 1000, 1 << 16), (3, 7, 4, 64), (40, 2000, 1, 1 << 16)])
def test_collocations_by_brute_force(spark, monkeypatch, least, top, stretch, bits):
    """Stretches of one word and a filter too small to hold anything back change nothing."""
    monkeypatch.setattr(P, "STRETCH", stretch)
    monkeypatch.setattr(P, "LEAST_BITS", bits)
    monkeypatch.setattr(P, "MOST_BITS", bits)
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, lang, "s", 7, "k", 1) for i, (lang, t) in enumerate(rows)], SCHEMA)
    found = [tuple(r) for r in P.collocations(docs, 5, least, top).collect()]
    assert sorted(found) == by_brute_force(rows, 5, least, top) and found


def test_pairs_only(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in P.collocations(docs, 2, 5).collect()) == by_brute_force(rows, 2, 5, 2000)


def test_phrases_of_odd_rows(spark):
    assert P.collocations(documents(spark, odd_texts())).count() == 0
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = documents(spark, ["big red dog"] * 100)
    assert [tuple(r) for r in P.collocations(twice).collect()] == [("en", 1, "big red dog", 100, 100, 100, 300, 3000)]


def test_counts_beyond_64_bits(spark, monkeypatch):
    """The products of the score are decimals: a count of 10^15 among just under 10^16 words."""
    big = spark.createDataFrame([("en", "a", 1, 10**15), ("en", "b", 1, 3 * 10**15), ("en", "a b", 2, 10**15 - 1)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(P, "phrase_counts", lambda *_: (big, spark.createDataFrame([("en", 10**16 - 1)], "lang string, n long")))
    r = P.collocations(spark.createDataFrame([], SCHEMA)).collect()[0]
    assert r.score == 1000 * (10**15 - 1) * (10**16 - 1) // (10**15 * 3 * 10**15)


@tables
def test_phrases_same_as_sql(spark):
    assert oracle.by_spark(Q.op11_phrases(spark, SF)) == oracle.by_sql(Q.OP11_SQL, SF)
