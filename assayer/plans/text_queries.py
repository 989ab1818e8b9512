"""Queries of functions, rules and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.functions import text as T
from assayer.operators.rules import Condition, Rule, first_match
from assayer.plans.registry import query
from assayer.plans.views import table
from assayer.sources.datasets import profile, union_columns

TOK = r"""tok AS (SELECT doc_id, regexp_extract_all(strip_accents(translate(lower(replace(text, 'İ', 'i')), 'ışğçöüâîû', 'isgcouaiu')), '[\p{L}\p{N}_]+') AS t FROM documents)"""
FEAT = TOK + r""", feat AS (SELECT doc_id, list_distinct(list_concat(list_transform(t, lambda x: 'w:' || x),
 list_transform(list_filter(t, lambda x: length(x) > 5 AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'p5:' || x[1:5]),
 list_transform(range(1, len(t)), lambda i: 'b:' || t[i] || '_' || t[i + 1]))) AS f FROM tok)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))


@query(f"WITH {TOK} SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok")
def fold_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {FEAT} SELECT doc_id, len(f)::BIGINT AS n, md5(array_to_string(list_sort(f), ' ')) AS digest, CASE WHEN len(f) > 0 THEN round(1 / sqrt(len(f)), 6) END AS scale FROM feat")
def token_features(spark: SparkSession, d: str) -> DataFrame:
    f = _docs(spark, d).select("doc_id", T.token_features(F.col("t")).alias("f"))
    return f.select("doc_id", F.when(F.col("f").isNotNull(), F.size("f")).cast("long").alias("n"), F.md5(F.array_join(F.array_sort("f"), " ")).alias("digest"), F.when(F.size("f") > 0, F.round(1 / F.sqrt(F.size("f")), 6)).alias("scale"))


@query(f"WITH {FEAT}, x AS (SELECT unnest(f) AS f FROM feat) SELECT split_part(f, ':', 1) AS kind, count(DISTINCT f)::BIGINT AS vocabulary, count(*)::BIGINT AS uses FROM x GROUP BY 1")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    used = _docs(spark, d).select(F.explode(T.token_features(F.col("t"))).alias("f")).groupBy("f").agg(F.count("*").alias("c"))
    return used.groupBy(F.split_part("f", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("vocabulary"), F.sum("c").alias("uses"))


@query(r"SELECT p_partkey, length(p_name) <= 40 AND len(regexp_split_to_array(trim(p_name), '\s+')) <= 4 AS short, p_brand || ': ' || p_type AS state, sha256(trim(p_name)) AS hash FROM part")
def short_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.is_short(F.col("p_name")).alias("short"), F.concat_ws(": ", "p_brand", "p_type").alias("state"), T.state_hash(F.col("p_name")).alias("hash"))


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 237) || '…' ELSE text END AS preview, coalesce(trim(text) <> '' AND length(text) <= 64000, false) AS valid FROM documents")
def previews(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.preview(text).alias("preview"), F.coalesce((F.trim(text) != "") & (F.length(text) <= 64000), F.lit(False)).alias("valid"))


@query("""SELECT event_id, TRY_CAST(replace(trim(p), ',', '.') AS DOUBLE) AS number, CASE WHEN regexp_full_match(l, '-?[0-9]+\\.0+') THEN regexp_replace(l, '\\.0+$', '') ELSE l END AS label
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id || ',5' WHEN 1 THEN ' ' || event_id || '.0 ' WHEN 2 THEN 'x' || event_id END AS p, trim(CASE event_id % 4 WHEN 0 THEN event_id || ',5' WHEN 1 THEN ' ' || event_id || '.0 ' WHEN 2 THEN 'x' || event_id END) AS l FROM events)""")
def numbers_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case event_id % 4 when 0 then event_id || ',5' when 1 then ' ' || event_id || '.0 ' when 2 then 'x' || event_id end")
    return table(spark, d, "events").select("event_id", T.to_number(raw).alias("number"), T.to_label(raw).alias("label"))


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(-4, least(4, (l_extendedprice - m) / sd)), 6) AS z FROM lineitem, s""")
def zscore_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    s = rows.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd"))
    z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col("l_extendedprice") - F.col("m")) / F.col("sd")))
    return rows.join(F.broadcast(s)).select("l_orderkey", "l_linenumber", "l_partkey", F.round(z, 6).alias("z"))  # one row of statistics


@query("""WITH s AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN n >= 2 AND sd > 1e-9 THEN round(greatest(-4, least(4, (value - m) / sd)), 6) END AS z FROM s""")
def zscore_online(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = table(spark, d, "events").select("event_id", "value", F.count("value").over(w).alias("n"), F.avg("value").over(w).alias("m"), F.stddev_samp("value").over(w).alias("sd"))
    z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col("value") - F.col("m")) / F.col("sd")))
    return s.select("event_id", F.when((F.col("n") >= 2) & (F.col("sd") > 1e-9), F.round(z, 6)).alias("z"))


@query("SELECT event_id, je.key AS path, json_extract_string(props, '$.' || je.key) AS value FROM events, json_each(props) AS je")
def flatten_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("path", "value"))


ORDER_RULES = [
    Rule("big", "review", [Condition("o_totalprice", ">", 300000), Condition("o_orderstatus", "in", "O, P")], 5),
    Rule("urgent", "approve", [Condition("o_orderpriority", "contains", "URGENT"), Condition("o_totalprice", "<=", 100000)], 3),
    Rule("other", "reject", [Condition("o_orderstatus", "not_in", ["F", "O"])], 3),
    Rule("off", "reject", [Condition("o_totalprice", ">=", 0)], 9, enabled=False),
    Rule("rest", "approve", [Condition("o_orderstatus", "!=", "F")], 1),
]
RULE_CASE = """CASE WHEN o_totalprice > 300000 AND o_orderstatus IN ('O','P') THEN 'big' WHEN contains(lower(o_orderpriority), 'urgent') AND o_totalprice <= 100000 THEN 'urgent'
 WHEN o_orderstatus NOT IN ('F','O') THEN 'other' WHEN o_orderstatus <> 'F' THEN 'rest' END"""


@query(f"SELECT o_orderkey, rule, CASE rule WHEN 'big' THEN 'review' WHEN 'urgent' THEN 'approve' WHEN 'other' THEN 'reject' WHEN 'rest' THEN 'approve' END AS decision FROM (SELECT o_orderkey, {RULE_CASE} AS rule FROM orders)")
def rules_first_match(spark: SparkSession, d: str) -> DataFrame:
    return first_match(table(spark, d, "orders"), ORDER_RULES).select("o_orderkey", "rule", "decision")


@query(f"SELECT rule, count(*)::BIGINT AS hits FROM (SELECT {RULE_CASE} AS rule FROM orders) WHERE rule IS NOT NULL GROUP BY rule")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return first_match(table(spark, d, "orders"), ORDER_RULES).where("rule is not null").groupBy("rule").agg(F.count("*").alias("hits"))


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' AS eq, c_mktsegment <> 'BUILDING' AS ne, c_acctbal > 500 AS gt, c_acctbal >= 500 AS ge, c_acctbal < 500 AS lt, c_acctbal <= 500 AS le,
 c_nationkey IN (1, 2) AS among, c_nationkey NOT IN (1, 2) AS outside, contains(lower(c_name), 'customer') AS has, false AS missing FROM customer""")
def rules_each_operator(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    cases = {"eq": ("c_mktsegment", "==", "BUILDING"), "ne": ("c_mktsegment", "!=", "BUILDING"), "gt": ("c_acctbal", ">", 500), "ge": ("c_acctbal", ">=", 500), "lt": ("c_acctbal", "<", 500), "le": ("c_acctbal", "<=", 500), "among": ("c_nationkey", "in", "1,2"), "outside": ("c_nationkey", "not_in", [1, 2]), "has": ("c_name", "contains", "CUSTOMER"), "missing": ("c_name", "is_missing", None)}
    return df.select("c_custkey", *(Condition(*c).column(df).alias(k) for k, c in cases.items()))


PROFILED = """SELECT '{c}' AS "column", count({c})::BIGINT AS n, (count(*) - count({c}))::BIGINT AS missing, count(DISTINCT {c})::BIGINT AS "distinct", '{k}' AS kind, array_to_string(list_slice(list_sort(list(DISTINCT {c}::VARCHAR)), 1, 12), '|') AS first FROM part"""


@query(" UNION ALL ".join(PROFILED.replace("{c}", c).replace("{k}", k) for c, k in (("p_brand", "category"), ("p_size", "number"), ("p_retailprice", "number"))))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "part").select("p_brand", "p_size", "p_retailprice")).withColumn("first", F.array_join("values", "|")).drop("values")


@query("SELECT n_nationkey AS key, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def columns_union(spark: SparkSession, d: str) -> DataFrame:
    return union_columns([table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))])
