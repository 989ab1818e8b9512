"""Source divergence against a plain reading: zero cells, ties, sources without terms, languages that keep nothing."""

import random
import re
from collections import Counter, defaultdict

import pytest

from assayer.llm import divergence as D, queries as Q
import oracle
from test_llm import SCHEMA, SF, documents, odd_texts, tables


def by_brute_force(rows, least=3, top=200):
    docs = defaultdict(list)
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, of in docs.items():
        found = Counter(t for _, terms in of for t in set(terms))
        kept = {t for t, n in found.items() if n >= least}
        counts = {s: Counter() for s, _ in of}
        for s, terms in of:
            counts[s].update(t for t in terms if t in kept)

        def shares(c):
            return {t: 1 + D.SCALE * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        gap = lambda x, y: (x - y) * (x - y) // y
        for s in counts:
            apart = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(apart)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def some_rows():
    rng = random.Random(6)
    words = ["ab", "Cd", "é", "x1y", "_", "日本", "the", "The"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for _ in range(120)]
    return rows + [("en", "empty", None), ("en", "rare", "only here"), ("xx", "a", "no term thrice"), ("xx", "b", "none"), ("yy", "alone", "one one one"), ("en", "s1", "the " * 500)]


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 7, "k", 1) for i, (lang, source, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("least, top, held, stretch", [(3, 200, 1_000_000, 1 << 22), (1, 4, 5, 7), (1000, 200, 50, 1)])
def test_audit_by_brute_force(spark, monkeypatch, least, top, held, stretch):
    monkeypatch.setattr(D, "HELD", held)
    monkeypatch.setattr(D, "STRETCH", stretch)
    rows = some_rows()
    assert sorted(tuple(r) for r in D.audit(table_of(spark, rows), least, top).collect()) == by_brute_force(rows, least, top)


def test_histograms_count_every_term_once(spark):
    """The cells of a pair, zeros included, add up to the kept terms."""
    vectors = spark.createDataFrame([("en", "a", 5, [("s", 2), ("t", 3)]), ("en", "b", 2, [("s", 2)]), ("en", "c", 5, [("s", 2), ("t", 3)]), ("en", "d", 1, [("u", 1)])], "lang string, term string, total long, counts array<struct<source:string,n:bigint>>")
    pairs = spark.createDataFrame([("en", "s", "t"), ("en", "s", "u")], "lang string, s string, t string")
    kept = spark.createDataFrame([("en", 4)], "lang string, kept long")
    found = sorted((r.s, r.t, r.a, r.b, r.m) for r in D.joint_histograms(vectors, pairs, kept).collect())
    assert found == [("s", "t", 0, 0, 1), ("s", "t", 2, 0, 1), ("s", "t", 2, 3, 2), ("s", "u", 0, 1, 1), ("s", "u", 2, 0, 3)]


def test_shares_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15, 10**16, 5)], "c long, n long, v long").select(D.share("c", "n", "v").alias("p")).collect()[0]
    assert row.p == 1 + 10**9 * (10**15 + 1) // (10**16 + 5)


def test_audit_of_odd_rows(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    texts = odd_texts()
    rows = [("en", f"s{i % 3}", t) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in D.audit(documents(spark, texts)).collect()) == by_brute_force(rows)


@tables
def test_audit_same_as_sql(spark):
    assert oracle.by_spark(Q.op13_source_divergence(spark, SF)) == oracle.by_sql(Q.OP13_SQL, SF)
