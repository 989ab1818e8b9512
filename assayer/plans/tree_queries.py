"""Queries of decision-tree statistics on orders: split candidates, the split decision, simplified rules, class-balanced capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.operators import feedback as L, trees as R
from assayer.plans.registry import query
from assayer.plans.views import table

r6 = lambda c: F.round(c, 6)
CLASSES = ["F", "O", "P"]
ENTROPY = "list_sum(list_transform({v}, lambda q: CASE WHEN q > 0 THEN -(q / list_sum({v})) * log2(q / list_sum({v})) ELSE 0 END))"
NUMERIC = f"""g AS (SELECT o_orderstatus AS y, count(*) AS n, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
e AS (SELECT min(lo) AS a, max(hi) AS b FROM g), c AS (SELECT a + (b - a) / 11 * i AS t FROM e, range(1, 11) AS r(i)),
z AS (SELECT t, y, n, lo, hi, (t - m) / greatest(sd, 1e-12) AS z FROM g, c), u AS (SELECT *, abs(z) / sqrt(2) AS x FROM z), k AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS q FROM u),
f AS (SELECT *, 1 - q * (0.254829592::DOUBLE + q * (-0.284496736::DOUBLE + q * (1.421413741::DOUBLE + q * (-1.453152027::DOUBLE + q * 1.061405429::DOUBLE)))) * exp(-x * x) AS erf FROM k),
w AS (SELECT t, y, n::DOUBLE AS n, CASE WHEN t < lo THEN 0 WHEN t >= hi THEN n ELSE n * CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END END::DOUBLE AS l FROM f),
v AS (SELECT t, list(l ORDER BY y) AS x, list(n - l ORDER BY y) AS r, list(n ORDER BY y) AS p FROM w GROUP BY 1),
h AS (SELECT t, {ENTROPY.format(v="p")} - (list_sum(x) * {ENTROPY.format(v="x")} + list_sum(r) * {ENTROPY.format(v="r")}) / list_sum(p) AS merit, list_sum(x) / list_sum(p) AS share FROM v),
num AS (SELECT t, CASE WHEN share >= 0.01 AND share <= 0.99 THEN merit END AS merit FROM h)"""
NOMINAL = f"""nc AS (SELECT o_orderpriority AS value, [count(*) FILTER (o_orderstatus = 'F')::DOUBLE, count(*) FILTER (o_orderstatus = 'O')::DOUBLE, count(*) FILTER (o_orderstatus = 'P')::DOUBLE] AS x FROM orders GROUP BY 1),
nt AS (SELECT [sum(x[1]), sum(x[2]), sum(x[3])] AS p, count(*) AS k FROM nc), nr AS (SELECT value, x, p, k, [p[1] - x[1], p[2] - x[2], p[3] - x[3]] AS r FROM nc, nt),
nom AS (SELECT value, {ENTROPY.format(v="p")} - (list_sum(x) * {ENTROPY.format(v="x")} + list_sum(r) * {ENTROPY.format(v="r")}) / list_sum(p) AS merit, (x[1] + 1) / (p[1] + k) AS likelihood FROM nr)"""


@query(f"WITH {NUMERIC} SELECT round(t, 4) AS threshold, round(merit, 6) AS merit FROM num")
def numeric_splits(spark: SparkSession, d: str) -> DataFrame:
    """Ten thresholds of the price, judged by each class's Gaussian."""
    stats = R.class_gaussians(table(spark, d, "orders"), [], "o_totalprice", "o_orderstatus")
    return R.numeric_splits(stats, [], "o_orderstatus", CLASSES).select(F.round("threshold", 4).alias("threshold"), r6("merit").alias("merit"))


@query(f"WITH {NOMINAL} SELECT value, round(merit, 6) AS merit, round(likelihood, 6) AS likelihood FROM nom")
def nominal_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """Each priority against the others: gain, and how likely the first class is to have it."""
    rows = R.nominal_splits(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", CLASSES)
    return rows.select("value", r6("merit").alias("merit"), r6(F.get("likelihood", 0)).alias("likelihood"))


@query(f"""WITH {NUMERIC}, {NOMINAL}, b AS (SELECT 'o_totalprice' AS feature, max(merit) AS merit FROM num UNION ALL SELECT 'o_orderpriority', max(merit) FROM nom), o AS (SELECT *, row_number() OVER (ORDER BY merit DESC, feature) AS k FROM b),
s AS (SELECT max(feature) FILTER (k = 1) AS feature, max(merit) FILTER (k = 1) AS merit, coalesce(max(merit) FILTER (k = 2), 0) AS second, (SELECT count(*) FROM orders) AS n FROM o)
SELECT feature, round(merit, 6) AS merit, round(second, 6) AS second, round(sqrt(log2(3) * log2(3) * ln(1 / 1e-7) / (2 * n)), 6) AS bound, merit > 0 AND (merit - second > sqrt(log2(3) * log2(3) * ln(1 / 1e-7) / (2 * n)) OR sqrt(log2(3) * log2(3) * ln(1 / 1e-7) / (2 * n)) < 0.05) AS splits FROM s""")
def split_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether a leaf with all orders splits, and on what."""
    orders = table(spark, d, "orders")
    price = R.numeric_splits(R.class_gaussians(orders, [], "o_totalprice", "o_orderstatus"), [], "o_orderstatus", CLASSES).agg(F.max("merit").alias("merit")).select(F.lit("o_totalprice").alias("feature"), "merit")
    priority = R.nominal_splits(orders, "o_orderpriority", "o_orderstatus", CLASSES).agg(F.max("merit").alias("merit")).select(F.lit("o_orderpriority").alias("feature"), "merit")
    n = orders.agg(F.count("*").alias("n"))
    best = price.union(priority).join(F.broadcast(n))  # one row
    return R.split_decision(best, F.col("n"), len(CLASSES)).select("feature", r6("merit").alias("merit"), r6("second").alias("second"), r6("bound").alias("bound"), "splits")


COND = """c AS (SELECT p_partkey // 10 AS path, p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 'size' WHEN 1 THEN 'size' WHEN 2 THEN 'price' ELSE 'brand' END AS feature, CASE p_partkey % 5 WHEN 0 THEN '<=' WHEN 1 THEN '>' WHEN 2 THEN '<=' WHEN 3 THEN '!=' ELSE CASE WHEN p_partkey % 4 = 0 THEN '==' ELSE '!=' END END AS op,
 CASE WHEN p_partkey % 5 < 2 THEN p_size::DOUBLE::VARCHAR WHEN p_partkey % 5 = 2 THEN p_retailprice::VARCHAR ELSE p_brand END AS value FROM part)"""


@query(f"""WITH {COND}, m AS (SELECT path, feature, max(CASE WHEN op = '>' THEN value::DOUBLE END) AS lower, min(CASE WHEN op = '<=' THEN value::DOUBLE END) AS upper, arg_max(value, pos) FILTER (op = '==') AS equal, list_sort(list(DISTINCT value) FILTER (op = '!=')) AS others FROM c GROUP BY 1, 2)
SELECT path, feature, '>' AS op, lower::VARCHAR AS value FROM m WHERE lower IS NOT NULL UNION ALL SELECT path, feature, '<=', upper::VARCHAR FROM m WHERE upper IS NOT NULL UNION ALL SELECT path, feature, '==', equal FROM m WHERE equal IS NOT NULL
UNION ALL SELECT path, feature, CASE WHEN len(others) > 1 THEN 'not_in' ELSE '!=' END, array_to_string(others, ',') FROM m WHERE equal IS NULL AND len(others) > 0""")
def simplified_rules(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of paths through a tree, those on one feature merged."""
    k = F.col("p_partkey") % 5
    feature = F.when(k < 2, "size").when(k == 2, "price").otherwise("brand")
    op = F.when(k == 0, "<=").when(k == 1, ">").when(k == 2, "<=").when((k == 4) & (F.col("p_partkey") % 4 == 0), "==").otherwise("!=")
    value = F.when(k < 2, F.col("p_size").cast("double").cast("string")).when(k == 2, F.col("p_retailprice").cast("string")).otherwise(F.col("p_brand"))
    conditions = table(spark, d, "part").select(F.expr("p_partkey div 10").alias("path"), F.col("p_partkey").alias("at"), feature.alias("feature"), op.alias("op"), value.alias("value"))
    return R.simplified(conditions, ["path"])


NUMBERS, NAMES, FLAGS = ["l_discount", "l_extendedprice", "l_quantity"], ["l_linenumber", "l_linestatus"], ["A", "N", "R"]
H3 = "list_sum(list_transform({v}, lambda q: CASE WHEN q > 0 THEN -(q / list_sum({v})) * log2(q / list_sum({v})) ELSE 0 END))"
#: A level of the tree in SQL: class Gaussians and counts by leaf, the best candidate of each feature, the decision, rows sent on.
LEVEL = f"""a$I AS (SELECT node, y, unnest([{", ".join(f"{{'f': '{c}', 'v': {c}::DOUBLE}}" for c in NUMBERS)}], recursive := true) FROM r$I),
g$I AS (SELECT node, f, y, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd, min(v) AS lo, max(v) AS hi FROM a$I WHERE v IS NOT NULL GROUP BY ALL), e$I AS (SELECT node, f, min(lo) AS a, max(hi) AS b FROM g$I GROUP BY ALL HAVING max(hi) > min(lo)),
z$I AS (SELECT e.node, e.f, a + (b - a) / 11 * i AS t, y, n, lo, hi, (a + (b - a) / 11 * i - m) / greatest(sd, 1e-12) AS z FROM e$I e JOIN g$I g ON g.node = e.node AND g.f = e.f, range(1, 11) AS s(i)),
k$I AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * (abs(z) / sqrt(2))) AS q, abs(z) / sqrt(2) AS x FROM z$I), c$I AS (SELECT *, 1 - q * (0.254829592::DOUBLE + q * (-0.284496736::DOUBLE + q * (1.421413741::DOUBLE + q * (-1.453152027::DOUBLE + q * 1.061405429::DOUBLE)))) * exp(-x * x) AS erf FROM k$I),
w$I AS (SELECT node, f, t, y, n::DOUBLE AS n, CASE WHEN t < lo THEN 0 WHEN t >= hi THEN n ELSE n * CASE WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END END::DOUBLE AS l FROM c$I),
v$I AS (SELECT node, f, t, NULL::VARCHAR AS value, list(l ORDER BY y) AS x, list(n - l ORDER BY y) AS r, list(n ORDER BY y) AS p FROM w$I GROUP BY ALL),
b$I AS (SELECT node, y, unnest([{", ".join(f"{{'f': '{c}', 'v': {c}::VARCHAR}}" for c in NAMES)}], recursive := true) FROM r$I), nc$I AS (SELECT node, f, v AS value, [{", ".join(f"count(*) FILTER (y = '{c}')::DOUBLE" for c in FLAGS)}] AS x FROM b$I WHERE v IS NOT NULL GROUP BY ALL),
nt$I AS (SELECT node, f, [sum(x[1]), sum(x[2]), sum(x[3])] AS p FROM nc$I GROUP BY ALL), u$I AS (SELECT * FROM v$I UNION ALL SELECT nc.node, nc.f, NULL, value, x, [p[1] - x[1], p[2] - x[2], p[3] - x[3]], p FROM nc$I nc JOIN nt$I nt ON nt.node = nc.node AND nt.f = nc.f),
h$I AS (SELECT node, f, t, value, {H3.format(v="p")} - (list_sum(x) * {H3.format(v="x")} + list_sum(r) * {H3.format(v="r")}) / list_sum(p) AS merit FROM u$I WHERE list_sum(x) >= 0.01 * list_sum(p) AND list_sum(r) >= 0.01 * list_sum(p)),
o$I AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY merit DESC, f) AS k, lead(merit) OVER (PARTITION BY node ORDER BY merit DESC, f) AS second FROM (SELECT * FROM h$I QUALIFY row_number() OVER (PARTITION BY node, f ORDER BY merit DESC, t, value) = 1)),
q$I AS (SELECT node, count(*) AS n, count(DISTINCT y) AS ys, [{", ".join(f"count(*) FILTER (y = '{c}')" for c in FLAGS)}] AS counts FROM r$I GROUP BY 1),
n$I AS (SELECT q.node, $I AS depth, n, counts, f, t, value, merit, coalesce(merit > 0 AND ys > 1 AND n >= 200 AND (merit - coalesce(second, 0) > sqrt(log2(greatest(ys, 2)) ** 2 * ln(1e7) / (2 * n)) OR sqrt(log2(greatest(ys, 2)) ** 2 * ln(1e7) / (2 * n)) < 0.05), false) AND $I < 2 AS splits FROM q$I q LEFT JOIN o$I o ON o.node = q.node AND k = 1),
j$I AS (SELECT r.*, CASE WHEN t IS NOT NULL THEN CASE f {" ".join(f"WHEN '{c}' THEN {c}::DOUBLE" for c in NUMBERS)} END <= t ELSE CASE f {" ".join(f"WHEN '{c}' THEN {c}::VARCHAR" for c in NAMES)} END = value END AS low FROM r$I r JOIN n$I n ON n.node = r.node AND splits),
r$N AS MATERIALIZED (SELECT node || CASE WHEN coalesce(low, count(*) FILTER (low) OVER w >= count(*) FILTER (NOT low) OVER w) THEN '0' ELSE '1' END AS node, y, {", ".join(NUMBERS + NAMES)} FROM j$I WINDOW w AS (PARTITION BY node))"""
GROWN = f"WITH r0 AS (SELECT '' AS node, l_returnflag AS y, {", ".join(NUMBERS + NAMES)} FROM lineitem WHERE l_returnflag IS NOT NULL), " + ", ".join(LEVEL.replace("$I", str(i)).replace("$N", str(i + 1)) for i in range(3)) + ", nodes AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return R.grow(table(spark, d, "lineitem"), NUMBERS, NAMES, "l_returnflag", FLAGS, 2)


@query(f"{GROWN} SELECT node, depth::INT AS depth, n::BIGINT AS n, array_to_string(counts, ',') AS counts, CASE WHEN splits THEN f END AS feature, CASE WHEN splits THEN round(t, 4) END AS threshold, CASE WHEN splits THEN value END AS value, CASE WHEN splits THEN round(merit, 6) END AS merit, splits FROM nodes")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree of depth two on the return flag of order lines, grown level by level."""
    return _tree(spark, d).select("node", "depth", "n", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"), "feature", F.round("threshold", 4).alias("threshold"), "value", r6("merit").alias("merit"), "splits")


@query(f"""{GROWN}, st AS (SELECT l.node, i, p.f AS feature, p.t, p.value, substr(l.node, i::INT, 1) AS b FROM (SELECT node, unnest(range(1, length(node) + 1)) AS i FROM nodes WHERE NOT splits) l JOIN nodes p ON p.node = substr(l.node, 1, (i - 1)::INT)),
m AS (SELECT node, feature, max(round(t, 6)) FILTER (b = '1') AS lower, min(round(t, 6)) FILTER (b = '0') AS upper, arg_max(value, i) FILTER (b = '0') AS equal, list_sort(list(DISTINCT value) FILTER (b = '1' AND value IS NOT NULL)) AS others FROM st GROUP BY 1, 2),
s AS (SELECT node, feature || ' > ' || lower AS c FROM m WHERE lower IS NOT NULL UNION ALL SELECT node, feature || ' <= ' || upper FROM m WHERE upper IS NOT NULL UNION ALL SELECT node, feature || ' == ' || equal FROM m WHERE equal IS NOT NULL
 UNION ALL SELECT node, feature || CASE WHEN len(others) > 1 THEN ' not_in ' ELSE ' != ' END || array_to_string(others, ',') FROM m WHERE equal IS NULL AND len(others) > 0)
SELECT coalesce((SELECT string_agg(c, ' and ' ORDER BY c) FROM s WHERE s.node = nodes.node), '') AS rule, ['A', 'N', 'R'][list_position(counts, list_max(counts))] AS prediction, round(list_max(counts) / n, 6) AS confidence, n::BIGINT AS support, (row_number() OVER (ORDER BY n DESC, node))::INT AS rank FROM nodes WHERE NOT splits""")
def tree_rules(spark: SparkSession, d: str) -> DataFrame:
    """Its leaves as rules, by support."""
    rows = R.rules(_tree(spark, d), FLAGS)
    rank = F.row_number().over(Window.orderBy(F.desc("support"), "node"))  # a row for each leaf
    return rows.select("rule", "prediction", r6("confidence").alias("confidence"), "support", rank.alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events WHERE event_id % 7 <> 0 OR event_type = 'error'), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
c AS (SELECT max(k) AS cap FROM range(0, 100001) AS r(k) WHERE (SELECT sum(least(n, k)) FROM n) <= 300), x AS (SELECT 300 - (SELECT sum(least(n, cap)) FROM n, c) AS spare),
o AS (SELECT label, n, row_number() OVER (ORDER BY label) AS r FROM n, c WHERE n > cap), q AS (SELECT n.label, least(n.n, cap) + CASE WHEN coalesce(o.r, 1000000) <= spare THEN 1 ELSE 0 END AS keep FROM n LEFT JOIN o USING (label), c, x)
SELECT event_id, label FROM e JOIN q USING (label) WHERE age <= keep""")
def balanced_capacity(spark: SparkSession, d: str) -> DataFrame:
    """What a memory of 300 keeps that always drops the oldest entry of the most frequent answer."""
    rows = table(spark, d, "events").where("event_id % 7 <> 0 or event_type = 'error'").select("event_id", F.col("event_type").alias("label"))
    return L.balanced(rows, "label", "event_id", 300).select("event_id", "label")
