"""Queries of states: nested JSON, features, rendering, examples, hashed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions import numbers as N, states as S
from assayer.operators import sampling
from assayer.operators.rules import Condition, Rule, forced_by_rules
from assayer.plans.registry import query
from assayer.plans.views import table

r6 = lambda c: F.round(c, 6)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested states: objects, a list of values and a list of objects."""
    tags = F.array("o_orderpriority", F.col("o_orderstatus"))
    steps = F.array(F.struct((F.col("o_orderkey") % 7).alias("k"), F.lit(None).cast("boolean").alias("even")), F.struct(F.lit(2).cast("long").alias("k"), (F.col("o_custkey") % 2 == 0).alias("even")))
    state = F.to_json(F.struct(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").startswith("1").alias("urgent")).alias("flags")).alias("order"), tags.alias("tags"), steps.alias("steps")))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", state.alias("state"))


FLAT = """fl AS (SELECT o_orderkey, 'order.price' AS path, 'number' AS kind, o_totalprice AS number, NULL AS text FROM orders UNION ALL SELECT o_orderkey, 'order.status', 'text', NULL, o_orderstatus FROM orders
 UNION ALL SELECT o_orderkey, 'order.flags.urgent', 'bool', NULL, CASE WHEN o_orderpriority LIKE '1%' THEN 'true' ELSE 'false' END FROM orders
 UNION ALL SELECT o_orderkey, 'tags[]', 'list', NULL, o_orderpriority || ',' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'steps[0].k', 'number', o_orderkey % 7, NULL FROM orders
 UNION ALL SELECT o_orderkey, 'steps[1].k', 'number', 2, NULL FROM orders UNION ALL SELECT o_orderkey, 'steps[1].even', 'bool', NULL, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM orders)"""


@query(f"WITH {FLAT} SELECT o_orderkey, path, kind, number, CASE WHEN kind <> 'number' THEN text END AS text FROM fl")
def state_flat(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of nested states under their paths."""
    rows = _orders(spark, d).select("o_orderkey", F.explode(S.flat(F.col("state"))).alias("x"))
    text = F.when(F.col("x.kind") == "list", F.array_join("x.items", ",")).when(F.col("x.kind") != "number", F.col("x.text"))
    return rows.select("o_orderkey", "x.path", "x.kind", "x.number", text.alias("text"))


CATS = f"""{FLAT}, ct AS (SELECT o_orderkey, 'k:' || path || '=' || lower(text) AS f FROM fl WHERE kind IN ('bool', 'text') UNION ALL SELECT o_orderkey, 'k:' || path || '=' || lower(unnest(string_split(text, ','))) FROM fl WHERE kind = 'list')"""


@query(f"WITH {CATS} SELECT o_orderkey, string_agg(f, ' | ' ORDER BY f) AS categories FROM ct GROUP BY 1")
def state_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categorical features of booleans, short texts and list items."""
    return _orders(spark, d).select("o_orderkey", F.array_join(F.array_sort(S.categories(S.flat(F.col("state")))), " | ").alias("categories"))


@query(f"""WITH {CATS}, n AS (SELECT o_orderkey, path, number FROM fl WHERE kind = 'number'), s AS (SELECT path, avg(number) AS m, stddev_samp(number) AS sd FROM n JOIN orders USING (o_orderkey) WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 2 AND sd > 1e-9),
z AS (SELECT o_orderkey, path, greatest(-4, least(4, (number - m) / sd)) AS z FROM n JOIN s USING (path)), c AS (SELECT o_orderkey, count(DISTINCT f) AS c FROM ct GROUP BY 1)
SELECT o_orderkey, round(max(z) FILTER (path = 'order.price'), 6) AS price, (2 + any_value(c) + count(*))::BIGINT AS features, round(sqrt(2 + any_value(c) + sum(z * z)), 6) AS length FROM z JOIN c USING (o_orderkey) GROUP BY 1""")
def state_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sparse vectors of nested states, numbers scaled by labelled ones only (orders not pending), and their length."""
    flat = _orders(spark, d).select("o_orderkey", "o_orderstatus", S.flat(F.col("state")).alias("flat"))
    v = S.sparse(flat, S.number_stats(flat.where("o_orderstatus <> 'P'")))
    return v.select("o_orderkey", r6(F.element_at("features", F.lit("n:order.price"))).alias("price"), F.size("features").cast("long").alias("features"), r6(S.norm(F.col("features"))).alias("length"))


EVENT = """'{"user": ' || user_id || ', "kind": "' || event_type || '", "a": {"z": ' || event_id % 5 || ', "b": ' || (CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) || '}}'"""


@query("""SELECT event_id, '{"a": {"b": ' || (CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) || ', "z": ' || event_id % 5 || '}, "kind": "' || event_type || '", "user": ' || user_id || '}' AS state,
sha256('{"a": {"b": ' || (CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) || ', "z": ' || event_id % 5 || '}, "kind": "' || event_type || '", "user": ' || user_id || '}') AS hash,
'user: ' || user_id || ' | kind: ' || event_type || ' | a.z: ' || event_id % 5 || ' | a.b: ' || (CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END) AS text FROM events""")
def state_renderings(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON with its hash, and the readable form, of states whose keys come in any order."""
    rows = table(spark, d, "events").select("event_id", F.expr(EVENT).alias("s"))
    return rows.select("event_id", S.canonical(F.col("s")).alias("state"), S.state_hash(F.col("s")).alias("hash"), S.readable(S.flat(F.col("s"))).alias("text"))


@query("""WITH o AS (SELECT string_agg('⟦M⟧ ' || r_name || CASE WHEN r_regionkey % 2 = 0 THEN ': region ' || r_regionkey ELSE '' END, ' ' ORDER BY r_regionkey) AS o FROM region)
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'noul: ' || n_name || ' ⟦M⟧ true: yes, the statement is true ⟦M⟧ false: not so' ELSE 'choice: ' || n_name || ' ' || o END AS question FROM nation, o""")
def question_texts(spark: SparkSession, d: str) -> DataFrame:
    """Questions as text, each option behind a mark."""
    option = F.struct(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("region "), F.col("r_regionkey").cast("string"))).alias("description"))
    options = table(spark, d, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", option.alias("o")))), lambda x: x["o"]).alias("o"))  # five options
    yes_no = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("description")) for n, t in (("true", ""), ("false", "not so"))))
    rows = table(spark, d, "nation").join(F.broadcast(options)).withColumn("noul", F.col("n_nationkey") % 3 == 0)
    return rows.select("n_nationkey", S.question_text(F.when(F.col("noul"), "noul").otherwise("choice"), F.col("n_name"), F.when(F.col("noul"), yes_no).otherwise(F.col("o"))).alias("question"))


@query()
def hashed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a question and each document's state, as the small encoder takes them; crc32 has no SQL here."""
    ids = S.encoded(F.lit(f"choice: which language {S.MARK} en {S.MARK} de: German"), F.coalesce("text", F.lit("")), 1 << 20)
    return table(spark, d, "documents").select("doc_id", ids.alias("ids"))


@query("""WITH e AS (SELECT c_custkey, c_mktsegment, c_name, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '007' ELSE c_nationkey::VARCHAR END AS code FROM customer)
SELECT c_custkey, c_mktsegment AS answer, '{"c_name": "' || c_name || '", "c_acctbal": ' || c_acctbal || CASE WHEN code = '' THEN '' WHEN code = '007' THEN ', "code": "007"' ELSE ', "code": ' || code::DOUBLE END || '}' AS state FROM e""")
def row_examples(spark: SparkSession, d: str) -> DataFrame:
    """Table rows as examples: JSON of the columns that aren't blank, numbers as numbers unless they begin with a zero."""
    code = F.expr("case when c_custkey % 5 = 0 then '' when c_custkey % 5 = 1 then '007' else cast(c_nationkey as string) end")
    return S.examples(table(spark, d, "customer").withColumn("code", code), "c_mktsegment", ["c_name", "c_acctbal", "code"], "json").select("c_custkey", "answer", "state")


@query("""SELECT conv_id, turn, role AS answer, text || CASE WHEN turn % 2 = 0 THEN chr(32) || chr(10) || 'turn' ELSE '' END AS state FROM conversations WHERE coalesce(text, '') <> ''""")
def text_examples(spark: SparkSession, d: str) -> DataFrame:
    """Text examples: columns joined, blank ones left out."""
    rows = table(spark, d, "conversations").where("coalesce(text, '') <> ''").withColumn("more", F.when(F.col("turn") % 2 == 0, "turn").otherwise(""))
    return S.examples(rows, "role", ["text", "more"], "text").select("conv_id", "turn", "answer", "state")


SPLIT = "('0x' || substr(md5('q:' || doc_id), 1, 8))::BIGINT % 10"


@query(f"""WITH s AS (SELECT doc_id, lang, {SPLIT} AS b FROM documents WHERE lang IS NOT NULL) SELECT lang, CASE b WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS part, count(*)::BIGINT AS n FROM s GROUP BY 1, 2""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each part of a split by the hash of a key: the same wherever and whenever it is computed."""
    rows = table(spark, d, "documents").where("lang is not null")
    return rows.groupBy("lang", sampling.split_of(F.concat(F.lit("q:"), F.col("doc_id").cast("string")), "md5").alias("part")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('1:' || o_orderkey), o_orderkey) <= 40""")
def class_sample(spark: SparkSession, d: str) -> DataFrame:
    """40 orders of each class, in an order that is as good as random and always the same."""
    return sampling.per_class(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 40, 1).select("o_orderpriority", "o_orderkey")


@query(f"""WITH s AS (SELECT doc_id, source, lang, {SPLIT} AS b FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), o AS (SELECT DISTINCT lang FROM s WHERE b > 1),
c AS (SELECT source, lang, count(*) AS n FROM s WHERE b > 1 GROUP BY 1, 2), g AS (SELECT source, o.lang, coalesce(n, 0) + 0.5 AS w FROM (SELECT DISTINCT source FROM s WHERE b > 1) z CROSS JOIN o LEFT JOIN c USING (source, lang)),
p AS (SELECT source, lang, w / sum(w) OVER (PARTITION BY source) AS p, row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) AS k FROM g), t AS (SELECT s.*, best.lang AS best, best.p AS conf, own.p AS own FROM s JOIN p best ON best.source = s.source AND best.k = 1 JOIN p own ON own.source = s.source AND own.lang = s.lang WHERE b = 0),
q AS (SELECT t.*, (SELECT sum(p.p * p.p) FROM p WHERE p.source = t.source) AS sq FROM t)
SELECT count(*)::BIGINT AS labels, round(avg(CASE WHEN best = lang THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(-ln(greatest(own, 1e-6))), 6) AS nll, round(avg(sq - 2 * own + 1), 6) AS brier, round(avg(CASE WHEN conf >= 0.6 THEN 1 ELSE 0 END), 6) AS coverage FROM q""")
def holdout_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Base rates by source learnt from the training part of a hash split, scored on its test part."""
    part = sampling.split_of(F.concat(F.lit("q:"), F.col("doc_id").cast("string")), "md5")
    rows = table(spark, d, "documents").where("lang is not null and source is not null").select("source", "lang", part.alias("part"))
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    langs = sorted(r[0] for r in train.select("lang").distinct().collect())  # the question's options
    rates = train.groupBy("source").agg(F.array(*(F.count_if(F.col("lang") == o).cast("double") for o in langs)).alias("c")).select("source", N.normalized(F.transform("c", lambda c: c + 0.5)).alias("p"))
    return sampling.evaluation(test.join(rates, "source"), "p", "lang", langs).select(F.col("labels"), *(r6(c).alias(c) for c in ("accuracy", "nll", "brier", "coverage")))


STATE_RULES = [
    Rule("refunds", "billing", [Condition("$text", "contains", "purchase")], 4, id="a"),
    Rule("elsewhere", "shop", [Condition("user_id", "<", 100)], 3, id="b"),
    Rule("faults", "technical", [Condition("$text", "contains", "error"), Condition("value", ">", 20)], 1, id="c"),
]


@query("""WITH a AS (SELECT event_id, event_type, user_id, value, 0.5 + (event_id % 50) / 100::DOUBLE AS confidence, CASE WHEN contains(event_type, 'purchase') THEN 'refunds' WHEN user_id < 100 THEN 'elsewhere' WHEN contains(event_type, 'error') AND value > 20 THEN 'faults' END AS r FROM events),
h AS (SELECT *, CASE r WHEN 'refunds' THEN 'billing' WHEN 'faults' THEN 'technical' END AS hit FROM a)
SELECT event_id, coalesce(hit, 'billing') AS answer, CASE WHEN hit IS NULL THEN confidence ELSE 1 END AS confidence, hit IS NULL AND confidence < 0.6 AS abstain, CASE WHEN hit IS NULL THEN 'student' ELSE 'rule' END AS source, CASE WHEN hit IS NOT NULL THEN r END AS rule FROM h""")
def rules_in_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Rules over a state's fields and its text, of which the first that holds decides; one whose decision isn't asked for changes nothing."""
    conf = F.expr("0.5 + (event_id % 50) / 100D")
    rows = table(spark, d, "events").select("event_id", "user_id", "value", "event_type", F.lit("billing").alias("answer"), conf.alias("confidence"), (conf < 0.6).alias("abstain"), F.lit("student").alias("source"))
    out = forced_by_rules(rows, STATE_RULES, ["billing", "technical"], F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('"}')))
    return out.select("event_id", "answer", "confidence", "abstain", "source", "rule")
