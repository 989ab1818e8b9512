"""Queries of the log's writes: appends and latest-wins views, labels, deletions, registries, snapshots, listings, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators import feedback as L, versions as V
from assayer.plans.registry import query
from assayer.plans.views import decisions as dec, table

r6 = lambda c: F.round(c, 6)
#: Decisions of two questions, some labelled more than once, made of events.
ANSWERS = """da AS (SELECT 'd' || event_id AS decision_id, q AS question, event_id AS created_at, CASE WHEN q = 'kind' THEN event_type WHEN value > 20 THEN 'true' ELSE 'false' END AS answer,
 0.5::DOUBLE + (event_id * 37 + CASE WHEN q = 'kind' THEN 0 ELSE 11 END) % 50 / 100::DOUBLE AS confidence, CASE event_id % 3 WHEN 0 THEN 'teacher' ELSE 'student' END AS source FROM events, (VALUES ('kind'), ('high')) AS t(q)),
fb AS (SELECT 'd' || (event_id // 2 * 2) AS decision_id, CASE WHEN user_id % 3 = 0 THEN 'high' ELSE 'kind' END AS question, event_id AS since, CASE WHEN user_id % 3 = 0 THEN CASE WHEN value > 15 THEN 'true' ELSE 'false' END ELSE event_type END AS label FROM events WHERE event_id % 5 < 3)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    def answer(value, shift: int):
        conf = F.expr(f"0.5D + (event_id * 37 + {shift}) % 50 / 100D")
        return F.struct(value.alias("answer"), conf.alias("confidence"), (conf < 0.6).alias("abstain"), F.when(F.col("event_id") % 3 == 0, "teacher").otherwise("student").alias("source"))

    answers = F.create_map(F.lit("kind"), answer(F.col("event_type"), 0), F.lit("high"), answer(F.when(F.col("value") > 20, "true").otherwise("false"), 11))
    return table(spark, d, "events").select(F.concat(F.lit("d"), "event_id").alias("decision_id"), F.col("event_id").alias("created_at"), F.col("props").alias("state"), answers.alias("answers"))


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_id % 5 < 3")
    high = F.col("user_id") % 3 == 0
    label = F.when(high, F.when(F.col("value") > 15, "true").otherwise("false")).otherwise(F.col("event_type"))
    return rows.select(F.concat(F.lit("d"), F.expr("event_id div 2 * 2")).alias("decision_id"), F.when(high, "high").otherwise("kind").alias("question"), F.col("event_id").alias("at"), label.alias("label"))


@query(f"WITH {ANSWERS} SELECT decision_id, question, answer, round(confidence, 6) AS confidence, confidence < 0.6 AS abstain, source FROM da")
def decision_answers(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question of each decision: the second of a decision's two appends."""
    rows = L.decision_rows(_decisions(spark, d))[1]
    return rows.select("decision_id", "question", "answer", r6("confidence").alias("confidence"), "abstain", "source")


@query(f"WITH {ANSWERS}, l AS (SELECT decision_id, question, arg_max(label, since) AS label FROM fb GROUP BY 1, 2) SELECT decision_id, question, answer, label FROM da LEFT JOIN l USING (decision_id, question)")
def labelled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the last label given to each; none while pending."""
    return L.with_labels(L.decision_rows(_decisions(spark, d))[1], _feedback(spark, d)).select("decision_id", "question", "answer", "label")


@query(f"WITH {ANSWERS}, l AS (SELECT decision_id, question, arg_max(label, since) AS label FROM fb GROUP BY 1, 2), j AS (SELECT da.*, label FROM da LEFT JOIN l USING (decision_id, question)) SELECT decision_id, max(created_at) AS created_at, max(answer) FILTER (question = 'kind') AS kind, max(label) FILTER (question = 'kind') AS kind_label, max(label) FILTER (question = 'high') AS high_label FROM j GROUP BY 1")
def decision_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with their answers and labels by question."""
    decisions, answers = L.decision_rows(_decisions(spark, d))
    found = L.decisions_with_labels(decisions, L.with_labels(answers, _feedback(spark, d)))
    at = lambda c, q: F.element_at(c, F.lit(q))
    return found.select("decision_id", "created_at", at("answers", "kind").alias("kind"), at("labels", "kind").alias("kind_label"), at("labels", "high").alias("high_label"))


@query(f"WITH {ANSWERS}, f AS (SELECT decision_id, question, arg_min(label, since) AS label, min(since) AS since FROM fb GROUP BY 1, 2), c AS (SELECT f.*, answer = label AS correct FROM f JOIN da USING (decision_id, question)), x AS (SELECT question, count(*) AS conflicts FROM fb JOIN c USING (decision_id, question) WHERE fb.since > c.since GROUP BY 1) SELECT question, count(*)::BIGINT AS labels, round(avg(CASE WHEN correct THEN 1 ELSE 0 END), 6) AS accuracy, coalesce(any_value(conflicts), 0)::BIGINT AS conflicts FROM c LEFT JOIN x USING (question) GROUP BY 1")
def feedback_once(spark: SparkSession, d: str) -> DataFrame:
    """Feedback counts once for a question of a decision, against what was served; what comes later conflicts."""
    counted, conflicts = L.first_feedback(_feedback(spark, d), L.decision_rows(_decisions(spark, d))[1])
    n = conflicts.groupBy("question").agg(F.count("*").alias("conflicts"))
    out = counted.groupBy("question").agg(F.count("*").alias("labels"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"))
    return out.join(n, "question", "left").select("question", "labels", "accuracy", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


@query("SELECT event_id AS source_id, (5000 + row_number() OVER (ORDER BY event_id))::BIGINT AS event_id, event_type AS label FROM events WHERE event_id % 3 = 1")
def append_events(spark: SparkSession, d: str) -> DataFrame:
    """A batch of events with ids from the log's last one on."""
    batch = table(spark, d, "events").where("event_id % 3 = 1").select(F.col("event_id").alias("source_id"), F.col("event_type").alias("label"))
    return L.with_event_ids(batch, "source_id", F.floor(F.col("source_id") / 10_000), 5000).select("source_id", "event_id", "label")


@query("SELECT event_type AS name, min(event_id) AS created_at, max(event_id) AS updated_at, arg_max(value, event_id) AS spec FROM events GROUP BY 1")
def task_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each question, with when it was first written."""
    versions = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("created_at"), F.col("event_id").alias("updated_at"), F.col("value").alias("spec"))
    return L.latest_rows(versions, "name", "updated_at")


@query("WITH x AS (SELECT event_id, event_type AS question FROM events), k AS (SELECT max(event_id) // 2 AS h FROM events) SELECT question, count(*)::BIGINT AS n FROM x, k WHERE question <> 'error' AND (question <> 'view' OR event_id > h) GROUP BY 1")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """A log after two questions were deleted, one of which began anew afterwards."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("question"))
    end = rows.agg(F.max("event_id").alias("m"))
    gone = end.select(F.explode(F.array(F.struct(F.lit("error").alias("question"), F.col("m").alias("at")), F.struct(F.lit("view").alias("question"), F.expr("m div 2").alias("at")))).alias("x")).select("x.*")
    return L.without_question(rows, gone, at="event_id").groupBy("question").agg(F.count("*").alias("n"))


CHANGES = "c AS (SELECT 'm' || user_id AS id, event_id AS since, CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type = 'error' THEN 'retired' WHEN event_type = 'signup' THEN 'shadow' ELSE 'active' END AS status, CASE WHEN value > 20 THEN value END AS report FROM events)"


@query(f"WITH {CHANGES} SELECT id, min(since) AS created_at, arg_max(status, since) AS status, arg_max(report, since) AS report FROM c GROUP BY 1")
def checkpoint_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registered models, each field as last written."""
    return L.registry(_changes(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("case when event_type in ('click', 'view') then null when event_type = 'error' then 'retired' when event_type = 'signup' then 'shadow' else 'active' end")
    return table(spark, d, "events").select(F.concat(F.lit("m"), "user_id").alias("id"), F.col("event_id").alias("at"), status.alias("status"), F.when(F.col("value") > 20, F.col("value")).alias("report"))


@query(f"WITH {CHANGES}, r AS (SELECT id, min(since) AS created_at, arg_max(status, since) AS status FROM c GROUP BY 1) SELECT status, arg_max(id, created_at) AS id FROM r GROUP BY 1")
def checkpoints_by_status(spark: SparkSession, d: str) -> DataFrame:
    """The newest model of each status."""
    return L.latest_by_status(L.registry(_changes(spark, d)))


@query("""WITH b AS (SELECT event_type AS question, event_id // 100 AS batch, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY question ORDER BY batch) AS labels FROM b)
SELECT question, batch::BIGINT AS batch, labels::BIGINT AS labels FROM s WHERE labels // 250 > (labels - n) // 250""")
def snapshot_marks(spark: SparkSession, d: str) -> DataFrame:
    """Where a question's labels pass a multiple of 250: an automatic snapshot each."""
    return L.snapshot_marks(table(spark, d, "events").select(F.col("event_type").alias("question"), F.expr("event_id div 100").alias("batch")), ["question"], "batch")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def log_newest(spark: SparkSession, d: str) -> DataFrame:
    """A page of the log, newest first."""
    return L.page(table(spark, d, "events"), [F.desc("event_id")], 50, 100).select("event_id", "event_type")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 60")
def dataset_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a dataset's rows."""
    return L.page(table(spark, d, "part"), [F.asc("p_partkey")], 30, 60).select("p_partkey", "p_name")


@query("WITH w AS (SELECT * FROM (VALUES ('view'), ('error'), ('theme')) AS t(key)), s AS (SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT key, coalesce(value, -1) AS value FROM w LEFT JOIN s USING (key)")
def settings_with_default(spark: SparkSession, d: str) -> DataFrame:
    """Settings as last written, a default for those that never were."""
    settings = table(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("at"))
    wanted = spark.createDataFrame([("view",), ("error",), ("theme",)], "key string")
    return L.setting(settings, wanted, F.lit(-1.0))


@query(f"""WITH {ANSWERS}, l AS (SELECT decision_id, question, arg_max(label, since) AS label FROM fb GROUP BY 1, 2), j AS (SELECT da.*, label FROM da LEFT JOIN l USING (decision_id, question))
SELECT question, count(*)::BIGINT AS decisions, count(label)::BIGINT AS labels, (count(*) - count(label))::BIGINT AS pending, round(avg(CASE WHEN label = answer THEN 1 WHEN label IS NOT NULL THEN 0 END), 6) AS accuracy, round(avg(CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END), 6) AS abstained, max(created_at) AS last FROM j GROUP BY 1""")
def question_cards(spark: SparkSession, d: str) -> DataFrame:
    """What a list of questions shows of each."""
    rows = L.with_labels(L.decision_rows(_decisions(spark, d))[1], _feedback(spark, d))
    right = F.when(F.col("label").isNotNull(), (F.col("label") == F.col("answer")).cast("int"))
    return rows.groupBy("question").agg(F.count("*").alias("decisions"), F.count("label").alias("labels"), (F.count("*") - F.count("label")).alias("pending"), r6(F.avg(right)).alias("accuracy"), r6(F.avg((F.col("confidence") < 0.6).cast("int"))).alias("abstained"), F.max("created_at").alias("last"))


@query("""WITH RECURSIVE $DEC, n AS (SELECT max(event_id) AS n FROM events), q AS (SELECT DISTINCT event_type AS question FROM events),
r AS (SELECT question, unnest([3 * n // 8, 5 * n // 8, 7 * n // 8]) AS p, unnest([n // 4, 3 * n // 8 - 1, n // 2]) AS v FROM q, n),
c(question, version, hi) AS (SELECT question, unnest([1, 2, 3, 4]), unnest([n // 4, n // 2, 3 * n // 4, n]) FROM q, n UNION ALL SELECT c.question, c.version, arg_max(r.v, r.p) FROM c JOIN r ON r.question = c.question AND r.p <= c.hi GROUP BY c.question, c.version),
s AS (SELECT question, version, hi, coalesce((SELECT max(p) FROM r WHERE r.question = c.question AND p <= hi), -1) AS lo FROM c),
o AS (SELECT question, seq, seq + 40 AS pos, 'retract' AS op FROM dec WHERE labelled AND seq % 3 = 0 UNION ALL SELECT question, seq, seq + 200, 'restore' FROM dec WHERE labelled AND seq % 6 = 0),
gone AS (SELECT question, version, seq FROM o JOIN s USING (question) WHERE pos > lo AND pos <= hi GROUP BY ALL HAVING arg_max(op, pos) = 'retract')
SELECT question, version, count(*)::BIGINT AS labels, round(avg(ok), 6) AS accuracy, max(seq) AS last FROM dec JOIN s USING (question) LEFT JOIN gone USING (question, version, seq) WHERE labelled AND seq > lo AND seq <= hi AND gone.seq IS NULL GROUP BY 1, 2""")
def metrics_at_versions(spark: SparkSession, d: str) -> DataFrame:
    """What the measures were at four versions of a log with three rollbacks, one of them to before an earlier one; retracted labels are forgotten."""
    rows = dec(spark, d)
    top = F.broadcast(rows.agg(F.max("seq").alias("n")))  # one row
    kinds = rows.select("question").distinct().crossJoin(top)
    each = lambda *structs: kinds.select("question", F.inline(F.array(*(F.struct(*(F.expr(e).alias(c) for c, e in s.items())) for s in structs))))
    rollbacks = each({"at": "3 * n div 8", "to": "n div 4"}, {"at": "5 * n div 8", "to": "3 * n div 8 - 1"}, {"at": "7 * n div 8", "to": "n div 2"})
    asked = each(*({"version": str(k), "at": f"{k} * n div 4"} for k in range(1, 5)))
    labels = rows.where("labelled").withColumnsRenamed({"seq": "event_id"}).withColumn("at", F.col("event_id")).select("question", "event_id", "at", "ok")
    op = lambda every, name, after: labels.where(f"event_id % {every} = 0").select("question", "event_id", F.lit(name).alias("op"), (F.col("at") + after).alias("at"))
    active = V.as_of(labels, op(3, "retract", 40).unionByName(op(6, "restore", 200)), V.spans(asked, rollbacks))
    return active.groupBy("question", "version").agg(F.count("*").alias("labels"), r6(F.avg("ok")).alias("accuracy"), F.max("event_id").alias("last"))
