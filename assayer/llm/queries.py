"""One query for each operator of this package, and the SQL where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import quality_rules as rules
from assayer.llm import quality_model as grades
from assayer.llm.byte_bpe import code_texts
from assayer.llm.decontaminate import find_leaks
from assayer.llm.divergence import audit
from assayer.llm.html_text import extract_text
from assayer.llm.langid import identify_language, learn_dictionaries
from assayer.llm.line_templates import drop_recurring
from assayer.llm.lm_score import score_texts
from assayer.llm.mixing import mix_sources
from assayer.llm.neardup import near_duplicates
from assayer.llm.phrases import collocations
from assayer.llm.secret_scan import scan_secrets
from assayer.plans.views import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "draws")


def fold_of(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, learn_dictionaries(docs.where(fold_of(3) != 1)))
    return found.select("doc_id", F.coalesce(fold_of(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = grades.train(docs, table(spark, sf_dir, "labels"), grades.rating_grade(), 3)
    return grades.grade_documents(docs, model)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.verdict(rules.BASE)).alias("base_failed"), rules.verdict(rules.STANDARD).alias("kept"), "failed")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each quality rule rejects, alone and with the others, from the ledger's bits."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")), rules.STANDARD)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents"), report=True)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score_texts(docs, fold_of(5) != 1)
    return scores.select("doc_id", F.coalesce(fold_of(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = code_texts(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
e AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM t),
r AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS s(k)),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
  (length(text) - length(regexp_replace(text, '\p{L}', '', 'g')))::BIGINT AS n_letters
  FROM t LEFT JOIN n USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 10 * word_chars < 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_letters < 50 * word_chars THEN 128 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 > 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


ABLATIONS_SQL = OP6_SQL.rpartition("SELECT doc_id")[0] + ", ru AS (SELECT unnest([" + ", ".join(f"{{'rule': '{name}', 'bit': {bit}}}" for name, bit in rules.BIT.items()) + f"], recursive := true)) SELECT '{rules.STANDARD.version}' AS version, rule, count(*) FILTER (failed & bit > 0)::BIGINT AS failing, count(*) FILTER (failed = bit)::BIGINT AS only, count(*) FILTER (failed & ~bit = 0)::BIGINT AS kept_without FROM f, ru GROUP BY rule"


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w FROM documents),
g AS (SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM d, range(1, 6) AS s(k)),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE size = 1 GROUP BY lang),
m AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE size > 1 AND f >= 100),
x AS (SELECT m.lang, m.phrase, a, n, k, l.f AS l, r.f AS r, (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score FROM m JOIN t ON t.lang = m.lang, range(1, 5) AS s(k), c AS l, c AS r
  WHERE k < m.size AND l.lang = m.lang AND l.phrase = array_to_string(w[1:k], ' ') AND r.lang = m.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.lang = b.lang AND o.phrase <> b.phrase AND o.a >= b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e) WHERE rank <= 2000
"""


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
n AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM n JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"rule_ablations": rule_ablations}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6_SQL, "rule_ablations": ABLATIONS_SQL, "op11_phrases": OP11_SQL, "op13_source_divergence": OP13_SQL}
