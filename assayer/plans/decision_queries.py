"""Queries of decisions: metrics, order statistics, contract, policy, log and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.functions import numbers as N
from assayer.operators import calibration, contract as C, feedback as L, similarity as S
from assayer.operators.running import by_level, running, trailing
from assayer.plans.registry import query
from assayer.plans.views import decisions as dec, feedback_log as log, labelled_documents, table

r6 = lambda c: F.round(c, 6)
#: Keys, block and order of running sums: from the most confident down, and along the log.
down = lambda: (["question"], F.floor((1 - F.col("conf")) * 200), [F.desc("conf"), F.asc("seq")])
along = lambda: (["question"], F.floor(F.col("seq") / 20_000), [F.asc("seq")])
LEVELS = "lv AS (SELECT question, conf, count(*) AS n, sum(1 - ok) AS e, sum(CASE WHEN labelled THEN 1 ELSE 0 END) AS m, sum(1 - conf) AS st, sum(CASE WHEN labelled THEN (1 - ok) - (1 - conf) ELSE 0 END) AS res FROM dec {where} GROUP BY 1, 2), cum AS (SELECT question, conf, sum(n) OVER w AS n, sum(e) OVER w AS e, sum(m) OVER w AS m, sum(st) OVER w AS st, sum(res) OVER w AS res FROM lv WINDOW w AS (PARTITION BY question ORDER BY conf DESC))"
WILSON = "least(1, (e / n + 1.2816::DOUBLE * 1.2816 / (2 * n) + 1.2816 * sqrt((e / n) * (1 - e / n) / n + 1.2816::DOUBLE * 1.2816 / (4 * n * n))) / (1 + 1.2816::DOUBLE * 1.2816 / n))"


# metrics

@query("WITH $DEC SELECT question, least(floor(conf * 10), 9)::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(conf), 6) AS conf, round(avg(ok), 6) AS accuracy FROM dec WHERE labelled GROUP BY 1, 2")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    bins = F.least(F.floor(F.col("conf") * 10), F.lit(9)).alias("bin")
    return dec(spark, d).where("labelled").groupBy("question", bins).agg(F.count("*").alias("n"), r6(F.avg("conf")).alias("conf"), r6(F.avg("ok")).alias("accuracy"))


@query("WITH $DEC, b AS (SELECT question, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM dec WHERE labelled GROUP BY 1, 2) SELECT question, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def ece(spark: SparkSession, d: str) -> DataFrame:
    b = dec(spark, d).where("labelled").groupBy("question", F.least(F.floor(F.col("conf") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("ok").alias("a"))
    return b.groupBy("question").agg(r6(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


@query("""WITH $DEC SELECT question, count(*)::BIGINT AS n, round(avg(ok), 6) AS accuracy, round(avg(-ln(greatest(CASE WHEN ok = 1 THEN conf ELSE 1 - conf END, 1e-6))), 6) AS nll,
 round(avg(2 * (conf - ok) * (conf - ok)), 6) AS brier FROM dec WHERE labelled GROUP BY 1""")
def accuracy_nll_brier(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("ok") == 1, F.col("conf")).otherwise(1 - F.col("conf"))
    gap = F.col("conf") - F.col("ok")
    return dec(spark, d).where("labelled").groupBy("question").agg(F.count("*").alias("n"), r6(F.avg("ok")).alias("accuracy"), r6(F.avg(N.log_loss(p))).alias("nll"), r6(F.avg(2 * gap * gap)).alias("brier"))


@query("""WITH $DEC, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY seq DESC) AS k FROM dec WHERE labelled), p AS (SELECT *, CASE WHEN ok = 1 THEN conf ELSE 1 - conf END AS p FROM r WHERE k <= 1000)
SELECT question, count(*)::BIGINT AS n, round(avg(ok), 6) AS accuracy, round(avg(-ln(greatest(p, 1e-6))), 6) AS nll, round(avg(2 * (conf - ok) * (conf - ok)), 6) AS brier, round(avg(CASE WHEN conf >= 0.6 THEN ok END), 6) AS answered_accuracy FROM p GROUP BY 1""")
def metrics_window(spark: SparkSession, d: str) -> DataFrame:
    """The measures of each question's last 1000 labels."""
    last = dec(spark, d).where("labelled").withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("seq")))).where("k <= 1000")  # Spark keeps 1000 rows of a key before the shuffle
    p = F.when(F.col("ok") == 1, F.col("conf")).otherwise(1 - F.col("conf"))
    gap = F.col("conf") - F.col("ok")
    return last.groupBy("question").agg(F.count("*").alias("n"), r6(F.avg("ok")).alias("accuracy"), r6(F.avg(N.log_loss(p))).alias("nll"), r6(F.avg(2 * gap * gap)).alias("brier"), r6(F.avg(F.when(F.col("conf") >= 0.6, F.col("ok")))).alias("answered_accuracy"))


@query("""WITH o AS (SELECT o_orderkey, left(o_orderpriority, 1)::INT AS y, 1 + o_orderkey % 5 AS g FROM orders)
SELECT y::BIGINT AS level, count(*)::BIGINT AS n, round(avg((SELECT sum(power((CASE WHEN g <= k THEN 1 ELSE 0 END) - (CASE WHEN y <= k THEN 1 ELSE 0 END), 2)) FROM range(1, 5) AS t(k)) / 4), 6) AS rps FROM o GROUP BY 1""")
def rps(spark: SparkSession, d: str) -> DataFrame:
    """Ranked probability score of ordered levels, a one-hot forecast against the priority's level."""
    y, g = F.substring("o_orderpriority", 1, 1).cast("long"), 1 + F.col("o_orderkey") % 5
    score = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0.0), lambda a, k: a + F.pow((g <= k).cast("int") - (y <= k).cast("int"), F.lit(2.0))) / 4
    return table(spark, d, "orders").select(y.alias("level"), score.alias("s")).groupBy("level").agg(F.count("*").alias("n"), r6(F.avg("s")).alias("rps"))


@query("WITH $DEC, p AS (SELECT question, label, answer FROM dec WHERE labelled) SELECT question, label, answer AS predicted, count(*)::BIGINT AS n FROM p GROUP BY 1, 2, 3")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Labels against answers."""
    return dec(spark, d).where("labelled").groupBy("question", "label", F.col("answer").alias("predicted")).agg(F.count("*").alias("n"))


@query("""WITH $DEC, r AS (SELECT question, label, seq, ok, conf, row_number() OVER (PARTITION BY question ORDER BY seq DESC) AS k FROM dec WHERE labelled)
SELECT question, label, count(*)::BIGINT AS n, round(avg(ok), 6) AS accuracy, round(avg(CASE WHEN k <= 1000 THEN ok END), 6) AS lately FROM r GROUP BY 1, 2""")
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by class, of all labels and of the question's last 1000."""
    rows = dec(spark, d).where("labelled")
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("seq")))).where("k <= 1000")  # Spark keeps 1000 rows of a key before the shuffle
    late = last.groupBy("question", "label").agg(r6(F.avg("ok")).alias("lately"))
    return rows.groupBy("question", "label").agg(F.count("*").alias("n"), r6(F.avg("ok")).alias("accuracy")).join(late, ["question", "label"], "left").select("question", "label", "n", "accuracy", "lately")


@query("WITH $DEC SELECT source, count(*)::BIGINT AS n, round(1 - avg(ok), 6) AS error FROM dec WHERE labelled GROUP BY ROLLUP (source)")
def served_error_by_source(spark: SparkSession, d: str) -> DataFrame:
    return dec(spark, d).where("labelled").rollup("source").agg(F.count("*").alias("n"), r6(1 - F.avg("ok")).alias("error"))


@query("WITH $DEC SELECT question, CASE WHEN count(*) >= 20 THEN round(avg(ok), 6) END AS accuracy, count(*)::BIGINT AS n FROM dec WHERE labelled AND source = 'teacher' GROUP BY 1")
def teacher_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return dec(spark, d).where("labelled and source = 'teacher'").groupBy("question").agg(F.when(F.count("*") >= C.MIN_TEACHER, r6(F.avg("ok"))).alias("accuracy"), F.count("*").alias("n"))


@query("WITH $DEC, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY seq DESC) AS k FROM dec) SELECT question, round(avg(CASE WHEN conf < 0.6 THEN 1 ELSE 0 END), 6) AS abstained, round(avg(CASE WHEN source = 'teacher' THEN 1 ELSE 0 END), 6) AS taught FROM r WHERE k <= 500 GROUP BY 1")
def abstain_teacher_rates(spark: SparkSession, d: str) -> DataFrame:
    last = dec(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("seq")))).where("k <= 500")  # Spark keeps 500 rows of a key before the shuffle
    return last.groupBy("question").agg(r6(F.avg((F.col("conf") < 0.6).cast("int"))).alias("abstained"), r6(F.avg((F.col("source") == "teacher").cast("int"))).alias("taught"))


@query("""WITH $DEC, l AS (SELECT question, conf, round(conf * 1000000)::BIGINT AS x, count(*) AS n, sum(ok) AS k FROM dec WHERE labelled GROUP BY ALL)
SELECT question, conf, (sum(n) OVER w)::BIGINT AS near, round(((sum(k) OVER w) + 10 * conf) / ((sum(n) OVER w) + 10), 6) AS accuracy FROM l WINDOW w AS (PARTITION BY question ORDER BY x RANGE BETWEEN 100000 PRECEDING AND 100000 FOLLOWING)""")
def measured_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return C.measured_accuracy(dec(spark, d).where("labelled"), ["question"]).select("question", "conf", "near", r6("accuracy").alias("accuracy"))


@query("WITH s AS (SELECT event_type, user_id % 7 AS seed, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, (count(*) - count(v))::BIGINT AS missing FROM s GROUP BY 1")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("event_type", F.expr("user_id % 7").alias("seed")).agg(F.avg("value").alias("v"))
    return s.groupBy("event_type").agg(r6(F.avg("v")).alias("mean"), r6(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("sd"), (F.count("*") - F.count("v")).alias("missing"))


# base rates, splits

@query("SELECT quality, toxic, count(*)::BIGINT AS n, round((count(*) + 0.5) / (sum(count(*)) OVER () + 0.5 * count(*) OVER ()), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def base_rates(spark: SparkSession, d: str) -> DataFrame:
    c = labelled_documents(spark, d).groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    every = c.agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    return c.join(F.broadcast(every)).select("quality", "toxic", "n", r6((F.col("n") + 0.5) / (F.col("s") + 0.5 * F.col("k"))).alias("rate"))  # one row of totals


SPLIT = """c AS (SELECT o_orderpriority AS v, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
t AS (SELECT v, [a, b, p] AS x, [(sum(a) OVER ())::BIGINT - a, (sum(b) OVER ())::BIGINT - b, (sum(p) OVER ())::BIGINT - p] AS y, [(sum(a) OVER ())::BIGINT, (sum(b) OVER ())::BIGINT, (sum(p) OVER ())::BIGINT] AS z FROM c),
h AS (SELECT v, list_sum(x) AS nx, list_sum(y) AS ny, list_sum(z) AS nz, list_sum(list_transform(x, lambda q: CASE WHEN q > 0 THEN -(q / list_sum(x)) * log2(q / list_sum(x)) ELSE 0 END)) AS hx,
 list_sum(list_transform(y, lambda q: CASE WHEN q > 0 THEN -(q / list_sum(y)) * log2(q / list_sum(y)) ELSE 0 END)) AS hy, list_sum(list_transform(z, lambda q: CASE WHEN q > 0 THEN -(q / list_sum(z)) * log2(q / list_sum(z)) ELSE 0 END)) AS hz FROM t)"""


@query(f"WITH {SPLIT} SELECT v AS value, round(hz - (nx * hx + ny * hy) / nz, 6) AS gain, round(sqrt(log2(3) * log2(3) * ln(1000) / (2 * nz)), 6) AS bound FROM h")
def nominal_splits(spark: SparkSession, d: str) -> DataFrame:
    """Gain of each split on one value against the rest, with the bound that a split has to beat."""
    kinds = ["F", "O", "P"]
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(*(F.count_if(F.col("o_orderstatus") == k).alias(k) for k in kinds))
    t = c.join(F.broadcast(c.agg(*(F.sum(k).alias(f"z{k}") for k in kinds))))  # one row of totals
    x, z = [F.col(k) for k in kinds], [F.col(f"z{k}") for k in kinds]
    y = [b - a for a, b in zip(x, z)]
    nx, ny, nz = (sum(v[1:], v[0]) for v in (x, y, z))
    gain = N.entropy(z) - (nx * N.entropy(x) + ny * N.entropy(y)) / nz
    return t.select("value", r6(gain).alias("gain"), r6(N.hoeffding(F.log2(F.lit(3.0)), 1e-3, nz)).alias("bound"))


# order statistics

@query("""WITH $DEC, r AS (SELECT question, seq, ok, row_number() OVER w AS rank, avg(ok) OVER (PARTITION BY question ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY question) AS n FROM dec WHERE labelled WINDOW w AS (PARTITION BY question ORDER BY seq)),
e AS (SELECT question, n, min(1 << k) AS e FROM (SELECT DISTINCT question, n FROM r), range(0, 40) AS t(k) WHERE n // (1::BIGINT << k) <= 300 GROUP BY 1, 2)
SELECT question, rank::BIGINT AS labels, round(a, 6) AS accuracy FROM r JOIN e USING (question) WHERE rank % e = 0""")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the last 200 labels at each so many-th one: a power of two that leaves 300 points at most."""
    run = trailing(dec(spark, d).where("labelled"), *along(), {"hits": F.col("ok")}, 200)
    n = run.groupBy("question").agg(F.max("rank").alias("_n"))
    step = F.pow(F.lit(2.0), F.array_position(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.floor(F.col("_n") / F.pow(F.lit(2.0), k)) <= 300), True) - 1).cast("long")
    rows = run.join(F.broadcast(n.select("question", step.alias("_e"))), "question")  # one row for each question
    return rows.where("rank % _e = 0").select("question", F.col("rank").alias("labels"), r6(F.col("hits") / F.col("n")).alias("accuracy"))


@query("""WITH $DEC, r AS (SELECT question, row_number() OVER w AS k, avg(-ln(greatest(CASE WHEN ok = 1 THEN conf ELSE 1 - conf END, 1e-6))) OVER w AS loss, avg(ok) OVER (PARTITION BY question ORDER BY seq ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS a FROM dec WHERE labelled
 WINDOW w AS (PARTITION BY question ORDER BY seq)) SELECT question, k::BIGINT AS labels, round(loss, 5) AS loss, round(a, 6) AS accuracy FROM r WHERE k % 250 = 0""")
def prequential_loss(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("ok") == 1, F.col("conf")).otherwise(1 - F.col("conf"))
    rows = dec(spark, d).where("labelled")
    loss = running(rows, *along(), {"loss": N.log_loss(p)}).where("rank % 250 = 0").select("question", "rank", F.round(F.col("loss") / F.col("rank"), 5).alias("loss"))
    hits = trailing(rows, *along(), {"hits": F.col("ok")}, 500).select("question", "rank", r6(F.col("hits") / F.col("n")).alias("accuracy"))
    return loss.join(hits, ["question", "rank"]).withColumnRenamed("rank", "labels")


@query("""WITH $DEC, r AS (SELECT question, conf, row_number() OVER w AS k, sum(ok) OVER w AS hits, count(*) OVER (PARTITION BY question) AS n FROM dec WHERE labelled WINDOW w AS (PARTITION BY question ORDER BY conf DESC, seq)),
m AS (SELECT DISTINCT question, greatest(1, round_even(n * i / 20::DOUBLE, 0))::BIGINT AS k FROM r, range(1, 21) AS t(i))
SELECT question, k::BIGINT AS covered, round(k / n, 4) AS coverage, round(hits / k, 4) AS accuracy, round(conf, 4) AS threshold FROM r JOIN m USING (question, k)""")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy among the most confident, at twentieths of the labels (halves to even, repeated marks once)."""
    run = running(dec(spark, d).where("labelled"), *down(), {"hits": F.col("ok")})
    n = run.groupBy("question").agg(F.count("*").alias("n"))
    mark = lambda i: F.greatest(F.lit(1.0), F.rint(F.col("n") * i / F.lit(20.0))).cast("long")
    marks = n.select("question", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(20)), mark))).alias("rank"))
    r4 = lambda c: F.round(c, 4)
    return run.join(F.broadcast(marks), ["question", "rank"]).select("question", F.col("rank").alias("covered"), r4(F.col("rank") / F.col("n")).alias("coverage"), r4(F.col("hits") / F.col("rank")).alias("accuracy"), r4("conf").alias("threshold"))  # twenty marks of a question


@query("""WITH $DEC, r AS (SELECT question, ok, row_number() OVER w AS k, sum(1 - ok) OVER w AS e, count(*) OVER (PARTITION BY question) AS n FROM dec WHERE labelled WINDOW w AS (PARTITION BY question ORDER BY conf DESC, seq))
SELECT question, round(avg(e / k), 6) AS aurc, round(avg(CASE WHEN k <= (4 * n + 4) // 5 THEN 1 - ok END), 6) AS risk_at_80 FROM r GROUP BY 1""")
def aurc(spark: SparkSession, d: str) -> DataFrame:
    run = running(dec(spark, d).where("labelled").withColumn("bad", 1 - F.col("ok")), *down(), {"errors": F.col("bad")})
    n = run.groupBy("question").agg(F.count("*").alias("n"))
    top = F.when(F.col("rank") <= F.floor((4 * F.col("n") + 4) / 5), F.col("bad"))
    return run.join(F.broadcast(n), "question").groupBy("question").agg(r6(F.avg(F.col("errors") / F.col("rank"))).alias("aurc"), r6(F.avg(top)).alias("risk_at_80"))


@query("""WITH $DEC, r AS (SELECT question, ok, conf, row_number() OVER (PARTITION BY question ORDER BY conf DESC, seq) AS k, count(*) OVER (PARTITION BY question) AS n FROM dec WHERE labelled)
SELECT question, c AS coverage, round(avg(1 - ok), 6) AS risk, round(min(conf), 6) AS threshold FROM r, (VALUES (0.5::DOUBLE), (0.7), (0.9)) AS t(c) WHERE k <= ceil(c * n) GROUP BY 1, 2""")
def coverage_marks(spark: SparkSession, d: str) -> DataFrame:
    """The error among the most confident half, seven and nine tenths, and the confidence they end at."""
    run = running(dec(spark, d).where("labelled").withColumn("bad", 1 - F.col("ok")), *down(), {"errors": F.col("bad")})
    n = run.groupBy("question").agg(F.count("*").alias("n")).select("question", "n", F.explode(F.array(*map(F.lit, (0.5, 0.7, 0.9)))).alias("coverage"))
    ends = run.join(F.broadcast(n), "question").where(F.col("rank") == F.ceil(F.col("coverage") * F.col("n")))  # three marks of a question
    return ends.select("question", "coverage", r6(F.col("errors") / F.col("rank")).alias("risk"), r6("conf").alias("threshold"))


@query("WITH $DEC, " + LEVELS.format(where="WHERE labelled") + " SELECT question, max(CASE WHEN e / n <= 0.2 THEN n ELSE 0 END)::BIGINT AS covered FROM cum GROUP BY 1")
def oracle_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The most answers, by whole tie groups, with an error rate within the budget."""
    lv = by_level(dec(spark, d).where("labelled"), ["question"], "conf", {"n": F.lit(1), "e": 1 - F.col("ok")})
    return lv.groupBy("question").agg(F.max(F.when(F.col("upto_e") / F.col("upto_n") <= 0.2, F.col("upto_n")).otherwise(0)).alias("covered"))


@query("WITH $DEC SELECT question, (seq // 500)::BIGINT AS part, count(*)::BIGINT AS n, round(avg(ok), 6) AS accuracy FROM dec GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return dec(spark, d).groupBy("question", F.floor(F.col("seq") / 500).alias("part")).agg(F.count("*").alias("n"), r6(F.avg("ok")).alias("accuracy"))


PARTS = "p AS (SELECT question, seq // 500 AS t, avg(ok) AS v FROM dec GROUP BY 1, 2)"


@query(f"WITH $DEC, {PARTS}, x AS (SELECT question, arg_min(v, t) AS low, max(v) AS high FROM p GROUP BY 1) SELECT question, CASE WHEN high <= low THEN 0 ELSE min(CASE WHEN v >= low + 0.5 * (high - low) THEN t END) END::BIGINT AS half_life FROM p JOIN x USING (question) GROUP BY question, low, high")
def half_life(spark: SparkSession, d: str) -> DataFrame:
    p = dec(spark, d).groupBy("question", F.floor(F.col("seq") / 500).alias("t")).agg(F.avg("ok").alias("v"))
    x = p.groupBy("question").agg(F.min_by("v", "t").alias("low"), F.max("v").alias("high"))
    first = F.min(F.when(F.col("v") >= F.col("low") + 0.5 * (F.col("high") - F.col("low")), F.col("t")))
    return p.join(x, "question").groupBy("question", "low", "high").agg(first.alias("t")).select("question", F.when(F.col("high") <= F.col("low"), F.lit(0)).otherwise(F.col("t")).cast("long").alias("half_life"))


@query(f"WITH $DEC, {PARTS}, e AS (SELECT max(t) AS z FROM p), x AS (SELECT question, max(v) FILTER (t < z) AS best, max(v) FILTER (t = z) AS last FROM p, e GROUP BY 1) SELECT round(avg(best - last), 6) AS forgetting FROM x")
def forgetting_index(spark: SparkSession, d: str) -> DataFrame:
    p = dec(spark, d).groupBy("question", F.floor(F.col("seq") / 500).alias("t")).agg(F.avg("ok").alias("v"))
    x = p.join(F.broadcast(p.agg(F.max("t").alias("z")))).groupBy("question").agg(F.max(F.when(F.col("t") < F.col("z"), F.col("v"))).alias("best"), F.max(F.when(F.col("t") == F.col("z"), F.col("v"))).alias("last"))
    return x.agg(r6(F.avg(F.col("best") - F.col("last"))).alias("forgetting"))


# contract and policy

@query("WITH $DEC, g AS (SELECT question, source, sum(1 - ok) AS e, count(*) AS n FROM dec WHERE labelled GROUP BY 1, 2) SELECT question, source, round(" + WILSON + ", 6) AS upper FROM g")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    g = dec(spark, d).where("labelled").groupBy("question", "source").agg(F.sum(1 - F.col("ok")).alias("e"), F.count("*").alias("n"))
    return g.select("question", "source", r6(N.wilson_upper(F.col("e"), F.col("n"))).alias("upper"))


@query("WITH $DEC, " + LEVELS.format(where="WHERE labelled") + f" SELECT question, max(n)::BIGINT AS labels, CASE WHEN max(n) >= 30 THEN coalesce(min(CASE WHEN n >= 10 AND {WILSON} <= 0.3 THEN conf END), 1.01::DOUBLE) END AS threshold FROM cum GROUP BY 1")
def budget_threshold(spark: SparkSession, d: str) -> DataFrame:
    return C.budget_threshold(dec(spark, d).where("labelled"), ["question"], 0.3)


@query("WITH $DEC, " + LEVELS.format(where="") + " SELECT question, max(m)::BIGINT AS labels, CASE WHEN max(m) >= 30 THEN coalesce(min(CASE WHEN m >= 10 AND st / n + CASE WHEN m >= 10 THEN res / m ELSE 0 END <= 0.2 THEN conf END), 1.01::DOUBLE) END AS threshold FROM cum GROUP BY 1")
def expected_threshold(spark: SparkSession, d: str) -> DataFrame:
    return C.expected_threshold(dec(spark, d), ["question"], 0.2)


@query("""WITH $DEC, c AS (SELECT seq, 8 * (1 - conf) AS yes, 2 * conf AS no FROM dec) SELECT seq, round(yes, 6) AS yes, round(no, 6) AS no, CASE WHEN yes <= no THEN 'yes' ELSE 'no' END AS cheapest FROM c""")
def expected_cost(spark: SparkSession, d: str) -> DataFrame:
    c = C.expected_costs(F.array("conf", 1 - F.col("conf")), [[0.0, 8.0], [2.0, 0.0]])
    return dec(spark, d).select("seq", c.alias("c")).select("seq", r6(F.get("c", 0)).alias("yes"), r6(F.get("c", 1)).alias("no"), F.when(F.get("c", 0) <= F.get("c", 1), "yes").otherwise("no").alias("cheapest"))


TAU = "CASE WHEN seq % 3 = 0 THEN 0.95::DOUBLE WHEN seq % 3 = 1 THEN 0.7::DOUBLE END"
tau = lambda: F.expr(TAU.replace("::DOUBLE", "D"))
probs = lambda: F.array("conf", 1 - F.col("conf"))


def _decided(rows: DataFrame, policy: C.Policy, options: list[str] = ["yes", "no"]) -> DataFrame:
    d = rows.select("seq", policy.decide(probs(), options, tau()).alias("d")).select("seq", "d.*")
    return d.withColumn("expected_cost", r6("expected_cost"))


@query(f"""WITH $DEC, t AS (SELECT *, {TAU} AS t FROM dec) SELECT seq, 'yes' AS answer, greatest(0.9::DOUBLE, t) AS threshold, 'costs+' || CASE WHEN t IS NULL THEN 'risk_budget_warming_up' ELSE 'risk_budget' END AS rule,
 conf < greatest(0.9::DOUBLE, t) AS abstain, round((1 - conf) * 10, 6) AS expected_cost FROM t""")
def decide_strictest(spark: SparkSession, d: str) -> DataFrame:
    """Costs and a risk budget; the budget warms up where its threshold is unknown."""
    return _decided(dec(spark, d), C.Policy(cost_wrong=10, cost_abstain=1, risk_budget=0.05))


@query(f"""WITH $DEC, t AS (SELECT *, {TAU} AS t FROM dec) SELECT seq, 'yes' AS answer, coalesce(t, 0.6::DOUBLE) AS threshold, CASE WHEN t IS NULL THEN 'risk_budget_warming_up+threshold' ELSE 'risk_budget_expected' END AS rule,
 conf < coalesce(t, 0.6::DOUBLE) AS abstain, NULL::DOUBLE AS expected_cost FROM t""")
def decide_by_budget(spark: SparkSession, d: str) -> DataFrame:
    """A risk budget alone; the default threshold while it warms up."""
    return _decided(dec(spark, d), C.Policy(risk_budget=0.05, risk_budget_mode="expected"))


@query("""WITH $DEC, c AS (SELECT seq, conf, 8 * (1 - conf) AS yes, 0.5 * (1 - conf) + 4 * conf AS no FROM dec) SELECT seq, CASE WHEN yes <= no THEN 'yes' ELSE 'no' END AS answer, NULL::DOUBLE AS threshold, 'cost_matrix' AS rule,
 least(yes, no) > 1.5 AS abstain, round(least(yes, no), 6) AS expected_cost FROM c""")
def decide_by_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest answer by a cost matrix with an absent cell, abstaining if that is dearer."""
    return _decided(dec(spark, d), C.Policy(cost_matrix={"yes": {"no": 8}, "no": {"no": 0.5}}, cost_wrong=4, cost_abstain=1.5))


ACC = """t AS (SELECT question, CASE WHEN count(*) >= 20 THEN avg(ok) END AS teacher FROM dec WHERE labelled AND source = 'teacher' GROUP BY 1),
l AS (SELECT question, conf, round(conf * 1000000)::BIGINT AS x, count(*) AS n, sum(ok) AS k FROM dec WHERE labelled GROUP BY ALL),
a AS (SELECT question, conf, ((sum(k) OVER w) + 10 * conf) / ((sum(n) OVER w) + 10) AS measured FROM l WINDOW w AS (PARTITION BY question ORDER BY x RANGE BETWEEN 100000 PRECEDING AND 100000 FOLLOWING))"""


@query(f"""WITH $DEC, {ACC}, r AS (SELECT seq, conf, coalesce(measured, conf) AS m, teacher, conf < 0.75 AS low FROM dec LEFT JOIN a USING (question, conf) LEFT JOIN t USING (question)),
b AS (SELECT *, teacher IS NOT NULL AND (low AND m >= teacher OR NOT low AND m < teacher) AS turned FROM r)
SELECT seq, CASE WHEN turned THEN 'threshold+escalation_aware' ELSE 'threshold' END AS rule, low <> turned AS abstain FROM b""")
def escalation_aware(spark: SparkSession, d: str) -> DataFrame:
    """The student answers where it is measured to be as right as the teacher, and asks where it isn't."""
    rows = dec(spark, d)
    teacher = rows.where("labelled and source = 'teacher'").groupBy("question").agg(F.when(F.count("*") >= C.MIN_TEACHER, F.avg("ok")).alias("teacher"))
    measured = C.measured_accuracy(rows.where("labelled"), ["question"]).select("question", "conf", F.col("accuracy").alias("measured"))
    rows = rows.join(measured, ["question", "conf"], "left").join(F.broadcast(teacher), "question", "left")  # one row for each question
    policy = C.Policy(abstain_threshold=0.75, escalation_aware=True)
    decided = policy.escalating(policy.decide(probs(), ["yes", "no"]), probs(), ["yes", "no"], F.col("teacher"), F.coalesce("measured", "conf"))
    return rows.select("seq", decided.alias("d")).select("seq", "d.rule", "d.abstain")


@query("""WITH $DEC, a AS (SELECT question, sum(CASE WHEN conf >= 0.8 THEN 1 ELSE 0 END) AS g, sum(CASE WHEN conf >= 0.8 THEN 1 - ok ELSE 0 END) AS w, count(*) AS n FROM dec WHERE labelled GROUP BY 1)
SELECT question, n::BIGINT AS n, round(g / n, 6) AS coverage, round(w / g, 6) AS risk, round((w * 5 + (n - g))::DOUBLE, 6) AS cost, round((w * 5 + (n - g)) / n, 6) AS cost_each FROM a""")
def policy_replay(spark: SparkSession, d: str) -> DataFrame:
    abstain = C.Policy(cost_wrong=5, cost_abstain=1).decide(probs(), ["yes", "no"])["abstain"]
    out = C.replay(dec(spark, d).where("labelled"), ["question"], abstain, F.col("ok"), 5, 1)
    return out.select("question", "n", *(r6(c).alias(c) for c in ("coverage", "risk", "cost", "cost_each")))


@query("""WITH $DEC, c AS (SELECT question, CASE WHEN ok = 1 THEN 'yes' ELSE 'no' END AS label, 8 * (1 - conf) AS yes, 0.5 * (1 - conf) + 4 * conf AS no FROM dec WHERE labelled),
g AS (SELECT question, label, CASE WHEN yes <= no THEN 'yes' ELSE 'no' END AS answer, least(yes, no) <= 1.5 AS gave FROM c),
p AS (SELECT *, CASE WHEN NOT gave THEN 1.5 WHEN answer = label THEN 0 WHEN answer = 'yes' THEN 8 ELSE 4 END AS price FROM g)
SELECT question, count(*)::BIGINT AS n, count(*) FILTER (gave)::BIGINT AS answered, round(count(*) FILTER (gave) / count(*), 6) AS coverage, count(*) FILTER (gave AND answer <> label)::BIGINT AS wrong,
 CASE WHEN count(*) FILTER (gave) > 0 THEN round(count(*) FILTER (gave AND answer <> label) / count(*) FILTER (gave), 6) END AS risk, round(sum(price)::DOUBLE, 6) AS cost, round(sum(price)::DOUBLE / count(*), 6) AS cost_each FROM p GROUP BY 1""")
def policy_replay_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A cost-matrix policy on logged probabilities and labels."""
    rows = dec(spark, d).where("labelled").select("question", probs().alias("probs"), F.when(F.col("ok") == 1, "yes").otherwise("no").alias("label"))
    out = C.replay_policy(rows, ["question"], C.Policy(cost_matrix={"yes": {"no": 8}, "no": {"no": 0.5}}, cost_wrong=4, cost_abstain=1.5), ["yes", "no"])
    return out.select("question", "n", "answered", "wrong", *(r6(c).alias(c) for c in ("coverage", "risk", "cost", "cost_each")))


@query("""WITH c AS (SELECT event_type AS question, event_id AS since, round(value / 25) / 10 AS abstain_threshold FROM events WHERE event_id % 7 = 0),
l AS (SELECT *, lag(abstain_threshold) OVER w AS p, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY question ORDER BY since)), r AS (SELECT * FROM l WHERE k = 1 OR p IS DISTINCT FROM abstain_threshold)
SELECT question, since, abstain_threshold, (row_number() OVER w)::BIGINT AS version, lead(since) OVER w AS until FROM r WINDOW w AS (PARTITION BY question ORDER BY since)""")
def policy_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each question's policy from a log of settings; what changes nothing makes none."""
    changes = table(spark, d, "events").where("event_id % 7 = 0").select(F.col("event_type").alias("question"), F.col("event_id").alias("since"), (F.round(F.col("value") / 25) / 10).alias("abstain_threshold"))
    return C.policy_versions(changes, ["question"], "since", ["abstain_threshold"])


MODES = "CASE seq % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'auto' ELSE 'never' END AS escalate", "CASE seq % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'always' ELSE 'on_abstain' END AS mode"


@query(f"WITH $DEC, m AS (SELECT *, {', '.join(MODES)} FROM dec) SELECT seq, CASE WHEN source = 'rule' THEN 'rule' WHEN escalate = 'always' OR escalate = 'auto' AND (mode = 'always' OR mode = 'on_abstain' AND conf < 0.6) THEN 'teacher' ELSE 'student' END AS route FROM m")
def teacher_routing(spark: SparkSession, d: str) -> DataFrame:
    """Who answers: rules never escalate; a request asks always, never, or leaves it to the question's mode."""
    rows = dec(spark, d).selectExpr("*", *MODES)
    route = C.escalates(F.col("escalate"), F.col("mode"), F.col("conf") < C.DEFAULT_THRESHOLD)
    return rows.select("seq", F.when(F.col("source") == "rule", "rule").when(route, "teacher").otherwise("student").alias("route"))


# calibration

#: Golden-section search in SQL over a table ``l`` of $KEY, the logarithms a and b of two probabilities, and whether the first came.
GOLDEN = """bounds AS (SELECT ln(0.5::DOUBLE) AS lo, ln(4::DOUBLE) AS hi, (sqrt(5) - 1) / 2 AS g),
ends AS (SELECT lo, hi, hi - g * (hi - lo) AS x, lo + g * (hi - lo) AS y FROM bounds),
search($KEY, it, lo, hi, x, y, fx, fy) AS (SELECT $KEY, 0, lo, hi, x, e.y, avg(ln(exp(a / exp(x)) + exp(b / exp(x))) - CASE WHEN l.y THEN a ELSE b END / exp(x)), avg(ln(exp(a / exp(e.y)) + exp(b / exp(e.y))) - CASE WHEN l.y THEN a ELSE b END / exp(e.y)) FROM l, ends e GROUP BY ALL
 UNION ALL SELECT s.$KEY, it + 1, lo, hi, CASE WHEN b_left THEN z ELSE s.y END, CASE WHEN b_left THEN s.x ELSE z END,
  CASE WHEN b_left THEN avg(ln(exp(a / exp(z)) + exp(b / exp(z))) - CASE WHEN l.y THEN a ELSE b END / exp(z)) ELSE fy END, CASE WHEN b_left THEN fx ELSE avg(ln(exp(a / exp(z)) + exp(b / exp(z))) - CASE WHEN l.y THEN a ELSE b END / exp(z)) END
 FROM (SELECT *, CASE WHEN b_left THEN hi - (sqrt(5) - 1) / 2 * (hi - lo) ELSE lo + (sqrt(5) - 1) / 2 * (hi - lo) END AS z FROM (SELECT $KEY, it, x, y, fx, fy, fx < fy AS b_left, CASE WHEN fx < fy THEN lo ELSE x END AS lo, CASE WHEN fx < fy THEN y ELSE hi END AS hi FROM search WHERE it < 22)) AS s
  JOIN l ON l.$KEY = s.$KEY GROUP BY s.$KEY, it, lo, hi, s.x, s.y, fx, fy, b_left, z),
golden AS (SELECT $KEY, round(exp((lo + hi) / 2), 4) AS t FROM search WHERE it = 22)"""

@query("""WITH $DEC, x AS (SELECT seq, power(greatest(conf, 1e-12), 1 / 1.5::DOUBLE) AS a, power(greatest(1 - conf, 1e-12), 1 / 1.5::DOUBLE) AS b FROM dec) SELECT seq, round(a / (a + b), 6) AS p FROM x""")
def temper(spark: SparkSession, d: str) -> DataFrame:
    return dec(spark, d).select("seq", r6(F.get(N.tempered(F.array("conf", 1 - F.col("conf")), 1.5), 0)).alias("p"))


@query("""WITH $DEC, g AS (SELECT conf, ok, count(*) AS n FROM dec WHERE labelled GROUP BY 1, 2), t AS (SELECT i, exp(ln(0.5::DOUBLE) + i * (ln(4::DOUBLE) - ln(0.5::DOUBLE)) / 40) AS t FROM range(0, 41) AS r(i)),
l AS (SELECT i, t, power(greatest(conf, 1e-12), 1 / t) AS a, power(greatest(1 - conf, 1e-12), 1 / t) AS b, ok, n FROM g, t) SELECT i::BIGINT AS i, round(t, 6) AS t, round(sum(n * -ln(greatest(CASE WHEN ok = 1 THEN a ELSE b END / (a + b), 1e-6))) / sum(n), 6) AS nll FROM l GROUP BY 1, 2""")
def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    """The loss at each temperature of a log grid; labels are counted by confidence and outcome first."""
    g = dec(spark, d).where("labelled").groupBy("conf", "ok").agg(F.count("*").alias("n"))
    step = lambda i: F.exp(F.ln(F.lit(0.5)) + i * (F.ln(F.lit(4.0)) - F.ln(F.lit(0.5))) / 40)
    grid = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("t", step(F.col("i")))
    p = N.tempered(F.array("conf", 1 - F.col("conf")), F.col("t"))
    loss = F.col("n") * N.log_loss(F.get(p, 1 - F.col("ok")))
    return grid.groupBy(F.col("i").cast("long").alias("i"), "t").agg((F.sum(loss) / F.sum("n")).alias("l")).select("i", r6("t").alias("t"), r6("l").alias("nll"))


@query(f"""WITH RECURSIVE $DEC, l AS (SELECT question, ln(greatest(conf, 1e-12)) AS a, ln(greatest(1 - conf, 1e-12)) AS b, ok = 1 AS y FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY seq DESC) AS k FROM dec WHERE labelled) WHERE k <= 500), {GOLDEN.replace("$KEY", "question")}
SELECT q.question, CASE WHEN n >= 30 THEN t ELSE 1 END AS temperature FROM (SELECT question, count(*) AS n FROM l GROUP BY 1) q JOIN golden USING (question)""")
def best_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The temperature that suits each question's last 500 labels best, by golden-section search; 1 under 30 labels."""
    last = dec(spark, d).where("labelled").withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("seq")))).where("k <= 500")  # Spark keeps 500 rows of a key before the shuffle
    by = last.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("k", calibration.sample(F.array("conf", 1 - F.col("conf")), 1 - F.col("ok")).alias("s")))).alias("all"))  # 500 at most
    fit = calibration.fitted_temperature(F.transform("all", lambda x: x["s"]))
    return by.select("question", F.when(F.size("all") >= calibration.MIN_SAMPLES, fit).otherwise(1.0).alias("temperature"))


@query("WITH $DEC, f AS (SELECT seq, conf, (seq % 11) / 10::DOUBLE AS fam FROM dec) SELECT seq, round(CASE WHEN fam < 0.5 THEN fam / 0.5 * conf + (1 - fam / 0.5) / 2 ELSE conf END, 6) AS p, fam < 0.5 AS abstain FROM f")
def unfamiliar_shrink(spark: SparkSession, d: str) -> DataFrame:
    fam = (F.col("seq") % 11) / 10
    return dec(spark, d).select("seq", r6(F.when(fam < 0.5, fam / 0.5 * F.col("conf") + (1 - fam / 0.5) / 2).otherwise(F.col("conf"))).alias("p"), (fam < 0.5).alias("abstain"))


@query("WITH $DEC SELECT seq, greatest(20, least(500, floor(0.1::DOUBLE * seq)))::BIGINT AS probation, seq + 1 + greatest(20, least(500, floor(0.1::DOUBLE * seq)))::BIGINT AS due FROM dec")
def probation_schedule(spark: SparkSession, d: str) -> DataFrame:
    p = F.greatest(F.lit(20), F.least(F.lit(500), F.floor(0.1 * F.col("seq")))).cast("long")
    return dec(spark, d).select("seq", p.alias("probation"), (F.col("seq") + 1 + p).alias("due"))


# log

RETRACTED = "event_id % 17 = 0"


@query("WITH $LOG SELECT CASE WHEN retracted THEN 'retracted' ELSE source END AS source, count(*)::BIGINT AS n FROM log GROUP BY 1")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(F.when(F.col("retracted"), "retracted").otherwise(F.col("source")).alias("source")).agg(F.count("*").alias("n"))


def _retractions(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).where(RETRACTED)
    undone = rows.where("event_id % 34 = 0").select("event_id", F.lit("restore").alias("op"), F.lit(2).alias("at"))
    return rows.select("event_id", F.lit("retract").alias("op"), F.lit(1).alias("at")).union(undone)


@query("WITH $LOG SELECT event_id, source, label FROM log WHERE NOT retracted OR event_id % 34 = 0")
def active_events(spark: SparkSession, d: str) -> DataFrame:
    return L.active(log(spark, d), _retractions(spark, d)).select("event_id", "source", "label")


@query("WITH $LOG SELECT event_id FROM log EXCEPT SELECT event_id FROM log WHERE retracted")
def active_events_except(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("event_id").exceptAll(log(spark, d).where("retracted").select("event_id"))


@query("WITH $LOG SELECT label, count(*)::BIGINT AS n FROM log WHERE (NOT retracted OR event_id % 34 = 0) AND source <> 'teacher' GROUP BY 1")
def rebuild_excluding(spark: SparkSession, d: str) -> DataFrame:
    return L.active(log(spark, d), _retractions(spark, d)).where("source <> 'teacher'").groupBy("label").agg(F.count("*").alias("n"))


@query("WITH $LOG SELECT event_id, label, source FROM log WHERE source = 'human' AND (NOT retracted OR event_id % 34 = 0) ORDER BY event_id DESC LIMIT 30")
def retract_recent(spark: SparkSession, d: str) -> DataFrame:
    """The newest events that an undo takes back: active ones only."""
    return L.newest(log(spark, d), _retractions(spark, d), 30, "human").select("event_id", "label", "source")


@query("WITH $LOG SELECT event_id, label FROM log WHERE event_id > 100 AND NOT retracted ORDER BY event_id LIMIT 1000")
def log_page(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where("event_id > 100 and not retracted").orderBy("event_id").limit(1000).select("event_id", "label")


@query("WITH $DEC SELECT seq, question, conf FROM dec WHERE NOT labelled ORDER BY conf, seq DESC LIMIT 50")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return dec(spark, d).where("not labelled").orderBy("conf", F.desc("seq")).limit(50).select("seq", "question", "conf")


@query("WITH $DEC SELECT question, count(*)::BIGINT AS pending FROM dec WHERE NOT labelled GROUP BY 1")
def pending_count(spark: SparkSession, d: str) -> DataFrame:
    return dec(spark, d).where("not labelled").groupBy("question").agg(F.count("*").alias("pending"))


@query("WITH $DEC, $LOG SELECT seq, dec.question, conf, log.label, log.source FROM dec JOIN log ON seq = event_id WHERE labelled AND NOT retracted")
def decision_join(spark: SparkSession, d: str) -> DataFrame:
    labels = log(spark, d).where("not retracted").select(F.col("event_id").alias("seq"), "label", "source")
    return dec(spark, d).where("labelled").select("seq", "question", "conf").join(labels, "seq")


@query("""WITH $LOG, r AS (SELECT *, row_number() OVER (PARTITION BY annotator, label ORDER BY CASE source WHEN 'human' THEN 3 WHEN 'dataset' THEN 2 ELSE 1 END DESC, event_id DESC) AS k FROM log WHERE NOT retracted)
SELECT annotator, label, event_id, source FROM r WHERE k = 1""")
def train_dedup(spark: SparkSession, d: str) -> DataFrame:
    return L.training_rows(log(spark, d).where("not retracted"), ["annotator", "label"]).select("annotator", "label", "event_id", "source")


SNAP = "snap AS (SELECT event_type AS question, event_id AS version, CASE WHEN event_id % 50 = 0 THEN 'manual' ELSE 'automatic' END AS note FROM events WHERE event_id % 10 = 0)"


@query(f"WITH {SNAP}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY version DESC) AS k FROM snap WHERE note = 'automatic') SELECT question, version, note FROM r WHERE k <= 10 UNION ALL SELECT * FROM snap WHERE note <> 'automatic'")
def snapshot_prune(spark: SparkSession, d: str) -> DataFrame:
    snap = table(spark, d, "events").where("event_id % 10 = 0").select(F.col("event_type").alias("question"), F.col("event_id").alias("version"), F.when(F.col("event_id") % 50 == 0, "manual").otherwise("automatic").alias("note"))
    return L.kept_snapshots(snap)


@query("SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def settings_latest(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_settings(table(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("at")))


@query("WITH $LOG SELECT event_id, label FROM log WHERE NOT retracted ORDER BY event_id DESC LIMIT 2000")
def fifo_capacity(spark: SparkSession, d: str) -> DataFrame:
    """What a memory of 2000 entries holds: the newest labels, whatever their answers."""
    return log(spark, d).where("not retracted").orderBy(F.desc("event_id")).limit(S.CAPACITY).select("event_id", "label")
