"""Queries of votes, learners and time windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions import numbers as N, text as T
from assayer.operators import contract as C, patches as P, similarity as S, vector_index as X
from assayer.operators.hashed import hashed_sums
from assayer.operators.learners import KNOWN, TOLD, doubling, drift_restarts, drift_signal as drift, first_slopes, first_weights, linear_reasons, mixture_weights, prequential, softmax, two_forecasters
from assayer.operators.tables import written
from assayer.operators.rules import Condition, Rule, forced_by_rules
from assayer.plans.registry import query
from assayer.plans.text_queries import FEAT
from assayer.plans.views import decisions as dec, table, told
from assayer.streaming.decisions import windowed


#: Similarities of documents to earlier entries of a memory: candidates by rare features, cosine over all; ``mem`` is to be given.
NEAR = FEAT + """, x AS (SELECT doc_id, unnest(f) AS f, len(f) AS n FROM feat), ex AS (SELECT x.* FROM x JOIN mem USING (doc_id)),
rare AS (SELECT f FROM ex GROUP BY f HAVING count(*) <= (SELECT greatest(5, least($CAP, count(*) // 4)) FROM mem)),
ov AS (SELECT x.doc_id AS id, ex.doc_id AS entry, count(*) AS o FROM x JOIN rare USING (f) JOIN ex USING (f) WHERE ex.doc_id < x.doc_id GROUP BY 1, 2),
cand AS (SELECT id, entry FROM ov QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC, entry) <= 200),
al AS (SELECT x.doc_id AS id, ex.doc_id AS entry, round(count(*) / sqrt(any_value(x.n)::DOUBLE * any_value(ex.n)), 9) AS sim FROM x JOIN ex USING (f) WHERE ex.doc_id < x.doc_id GROUP BY 1, 2),
sims AS (SELECT al.* FROM al JOIN cand USING (id, entry)), state AS (SELECT doc_id, sha256(trim(coalesce(text, ''))) AS state FROM documents)"""
#: The same for a memory that moves: the 2000 newest entries before each document; ``lab`` is to be given.
ASOF = FEAT + """, x AS (SELECT doc_id, unnest(f) AS f, len(f) AS n FROM feat), mem AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM lab), ex AS (SELECT x.*, r FROM x JOIN mem USING (doc_id)),
pos AS (SELECT d.doc_id, coalesce(sum(CASE WHEN mem.r IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM documents d LEFT JOIN mem USING (doc_id)),
al AS (SELECT x.doc_id AS id, ex.doc_id AS entry, x.n, ex.n AS m, known, count(*) OVER (PARTITION BY x.doc_id, x.f) AS df FROM x JOIN pos USING (doc_id) JOIN ex USING (f) WHERE ex.r <= known AND ex.r > known - 2000),
ov AS (SELECT id, entry, count(*) FILTER (df <= greatest(5, least(known, 2000) // 4)) AS o, round(count(*) / sqrt(any_value(n)::DOUBLE * any_value(m)), 9) AS sim FROM al GROUP BY 1, 2),
sims AS (SELECT id, entry, sim FROM ov WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC, entry) <= 200),
state AS (SELECT doc_id, sha256(trim(coalesce(text, ''))) AS state FROM documents),
same AS (SELECT q.doc_id AS id, arg_max(e.doc_id, e.doc_id) AS entry FROM state q JOIN pos ON pos.doc_id = q.doc_id JOIN state e USING (state) JOIN mem ON mem.doc_id = e.doc_id WHERE r <= known AND r > known - 8000 GROUP BY 1)"""
LABELLED = "lab AS (SELECT doc_id, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as states, and those with a quality label as entries."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"), F.lit(1.0).alias("weight")).where("label is not null")
    return tuple(S.with_texts(rows, "doc_id", "text").drop("doc_id") for rows in (texts, told(texts, labels)))


@query(f"""WITH {LABELLED}, {ASOF},
near AS (SELECT * FROM sims WHERE sim >= 0.35 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, entry) <= 5),
vote AS (SELECT id, count(*) AS near, sum(CASE WHEN label = '1' THEN sim * sim ELSE 0 END) AS a, sum(sim * sim) AS t FROM near JOIN mem ON entry = mem.doc_id GROUP BY id),
said AS (SELECT id, label FROM same JOIN mem ON entry = mem.doc_id),
prior AS (SELECT d.doc_id, (coalesce(sum(CASE WHEN label = '1' THEN 1 ELSE 0 END) OVER w, 0) + 0.5) / (known + 1) AS p FROM documents d LEFT JOIN lab USING (doc_id) JOIN pos ON pos.doc_id = d.doc_id WINDOW w AS (ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT d.doc_id, coalesce(v.near, 0)::BIGINT AS near, s.label IS NOT NULL AS exact, coalesce(CASE s.label WHEN '1' THEN 0.95 WHEN '0' THEN 0.05 END, v.a / v.t * 0.9 + 0.05, prior.p) AS p FROM documents d LEFT JOIN vote v ON v.id = d.doc_id LEFT JOIN said s ON s.id = d.doc_id JOIN prior ON prior.doc_id = d.doc_id)
SELECT doc_id, near, exact, CASE WHEN p >= 0.5 THEN 'true' ELSE 'false' END AS answer, round(greatest(p, 1 - p), 6) AS confidence, 0.9::DOUBLE AS threshold, 'costs' AS rule, greatest(p, 1 - p) < 0.9 AS abstain FROM f""")
def minimum_slice(spark: SparkSession, d: str) -> DataFrame:
    """Is a document of good quality, and would a policy with those costs answer?  The same state's answer, else the vote of
    similar labels, else base rates, each as it was when the document came; then the contract."""
    docs, labelled = _vectors(spark, d)
    vote = S.memory_vote(docs, labelled, ["1", "0"]).join(S.counts_before(docs, labelled, ["1", "0"]), "id")
    rows = vote.select(F.col("id").alias("doc_id"), "near", "exact", F.coalesce("probs", P.base_rates(F.col("counts"))).alias("probs"))
    rows = rows.withColumn("d", C.Policy(cost_wrong=10, cost_abstain=1).decide(F.col("probs"), ["true", "false"]))
    return rows.select("doc_id", "near", "exact", "d.answer", F.round(F.array_max("probs"), 6).alias("confidence"), "d.threshold", "d.rule", "d.abstain")


#: One question of ``decide_documents`` in SQL: votes, the same state's label, base rates, the policy, a rule, who answers.
ASKED = """SELECT doc_id, '$Q' AS question, CASE WHEN short THEN '$F' WHEN p >= 0.5 THEN 'true' ELSE 'false' END AS answer, round(CASE WHEN short THEN 1 ELSE greatest(p, 1 - p) END, 6) AS confidence, NOT short AND greatest(p, 1 - p) < 0.9 AS abstain,
 CASE WHEN short THEN 'rule' WHEN asks AND greatest(p, 1 - p) < 0.9 THEN 'teacher' ELSE 'student' END AS source FROM (SELECT d.doc_id, coalesce(length(d.text), 0) < 200 AS short, d.doc_id % 5 = 0 AS asks,
 coalesce(CASE u.$Q WHEN 1 THEN 0.95 WHEN 0 THEN 0.05 END, v.p, b.p) AS p
 FROM documents d LEFT JOIN (SELECT id, sum(CASE WHEN $Q = 1 THEN sim * sim ELSE 0 END) / sum(sim * sim) * 0.9 + 0.05 AS p FROM near JOIN mem ON entry = mem.doc_id GROUP BY id) v ON v.id = d.doc_id LEFT JOIN (SELECT id, $Q FROM same JOIN mem ON entry = mem.doc_id) u ON u.id = d.doc_id,
 LATERAL (SELECT (coalesce(sum($Q), 0) + 0.5) / (count(*) + 1) AS p FROM lab WHERE lab.doc_id < d.doc_id) b)"""


@query("WITH lab AS (SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)), " + ASOF + """,
near AS (SELECT * FROM sims WHERE sim >= 0.35 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, entry) <= 5) """ + ASKED.replace("$Q", "quality").replace("$F", "false") + " UNION ALL " + ASKED.replace("$Q", "toxic").replace("$F", "false"))
def decide_documents(spark: SparkSession, d: str) -> DataFrame:
    """Two questions of each document: a rule, else the student with a policy, and the teacher is asked where it abstains and may."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    texts = texts.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)))
    labels = table(spark, d, "labels").select("doc_id", *(F.col(q).cast("string").alias(q) for q in ("quality", "toxic")), F.lit(1.0).alias("weight"))
    docs, labelled = (S.with_texts(rows, "doc_id", "text").drop("doc_id") for rows in (texts, told(texts, labels)))
    near = written(S.neighbours_as_of(docs, labelled, S.CAPACITY), "near")
    short, policy, out = [Rule("short", "false", [Condition("n_chars", "<", 200)])], C.Policy(cost_wrong=10, cost_abstain=1), []
    for q in ("quality", "toxic"):
        vote = S.votes(near, labelled.select(F.col("id").alias("entry"), F.col(q).alias("label"), "weight"), ["1", "0"], S.SMOOTH)
        same = S.exact_answers(docs, labelled.withColumn("label", F.col(q)), ["1", "0"])
        counts = S.counts_before(docs, labelled.withColumn("label", F.col(q)), ["1", "0"])
        rows = docs.select("id", "n_chars").join(vote, "id", "left").join(same, "id", "left").join(counts, "id").withColumn("probs", F.coalesce("exact", "probs", P.base_rates(F.col("counts"))))
        rows = rows.withColumn("d", policy.decide(F.col("probs"), ["true", "false"])).select("id", "n_chars", "d.answer", F.array_max("probs").alias("confidence"), "d.abstain", F.lit("student").alias("source"))
        rows = forced_by_rules(rows, short, ["true", "false"])
        asked = (F.col("source") != "rule") & C.escalates(F.lit("auto"), F.when(F.col("id") % 5 == 0, "on_abstain").otherwise("off"), F.col("abstain"))
        out.append(rows.select(F.col("id").alias("doc_id"), F.lit(q).alias("question"), "answer", F.round("confidence", 6).alias("confidence"), "abstain", F.when(asked, "teacher").otherwise(F.col("source")).alias("source")))
    return out[0].union(out[1])


@query(f"WITH {LABELLED}, {ASOF} SELECT id, entry, sim, (row_number() OVER (PARTITION BY id ORDER BY sim DESC, entry))::INT AS rank FROM sims WHERE sim >= 0.35 QUALIFY rank <= 5")
def memory_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The labelled entries a vote is taken from, as an explanation shows them."""
    docs, labelled = _vectors(spark, d)
    return S.neighbours_as_of(docs, labelled, S.CAPACITY).select("id", "entry", "sim", F.col("rank").cast("int").alias("rank"))


@query("""WITH q AS (SELECT a.vec_id AS query, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query, vec_id, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM q) SELECT query, vec_id, round(s, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 5""")
def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors of each query (ids divisible by 50) among all vectors."""
    all_ = table(spark, d, "embeddings")
    return S.vector_neighbours(all_.where("vec_id % 50 = 0"), all_).select("query", "vec_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rank"))


@query()
def embedding_index_knn(spark: SparkSession, d: str) -> DataFrame:
    """Those five by an inverted file of all vectors: a query probes as many lists as a recall of 0.95 was measured to need."""
    all_ = table(spark, d, "embeddings")
    index = X.vector_index(all_)
    found = X.index_neighbours(all_.where("vec_id % 50 = 0"), index, probes=X.probes_for(index))
    return found.select("query", "vec_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rank"))


#: A step of the drift signal in SQL: sums, the least of p + s, the status; a drift starts anew.
DRIFTING = """n1 AS (SELECT z.question, z.k + 1 AS k, r.seq, z.n + 1 AS n, z.errors + r.e AS errors, z.lo, z.lp, z.ls FROM z JOIN r ON r.question = z.question AND r.k = z.k + 1),
 p1 AS (SELECT *, (errors + 1) / (n + 2) AS p FROM n1), s1 AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p1), l1 AS (SELECT *, n >= 100 AND p + s <= lo AS best FROM s1),
 m1 AS (SELECT question, k, seq, n, errors, p, s, CASE WHEN best THEN p + s ELSE lo END AS lo, CASE WHEN best THEN p ELSE lp END AS lp, CASE WHEN best THEN s ELSE ls END AS ls FROM l1),
 t1 AS (SELECT *, CASE WHEN n < 100 OR errors < 5 THEN 'stable' WHEN p + s > lp + 3 * ls THEN 'drift' WHEN p + s > lp + 2 * ls THEN 'warning' ELSE 'stable' END AS status FROM m1)"""


@query(f"""WITH RECURSIVE $DEC, r AS (SELECT question, seq, 1 - ok AS e, row_number() OVER (PARTITION BY question ORDER BY seq) AS k FROM dec WHERE labelled),
z(question, k, seq, n, errors, said, errs, status, lo, lp, ls) AS (SELECT DISTINCT question, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', 1e9::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM r UNION ALL
 (WITH {DRIFTING} SELECT question, k, seq, CASE WHEN status = 'drift' THEN 0 ELSE n END, CASE WHEN status = 'drift' THEN 0 ELSE errors END, n, errors, status, CASE WHEN status = 'drift' THEN 1e9 ELSE lo END, lp, ls FROM t1))
SELECT question, seq, said AS n, errs AS errors, status FROM z WHERE k > 0""")
def drift_replay(spark: SparkSession, d: str) -> DataFrame:
    """Warnings and drifts of each question over the whole log; the signal starts anew after each drift."""
    rows = dec(spark, d).where("labelled").select("question", "seq", "ok")
    return drift_restarts(rows, ["question"], "seq", 1 - F.col("ok")).select("question", "seq", "n", "errors", "status")


@query("""WITH $DEC, r AS (SELECT question, seq, 1 - ok AS e, row_number() OVER w AS n, sum(1 - ok) OVER w AS errors FROM dec WHERE labelled WINDOW w AS (PARTITION BY question ORDER BY seq)),
p AS (SELECT *, (errors + 1) / (n + 2) AS p FROM r), s AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p), m AS (SELECT *, CASE WHEN n >= 100 THEN p + s END AS ps FROM s),
l AS (SELECT *, arg_min(p, ps) OVER w AS lp, arg_min(s, ps) OVER w AS ls FROM m WINDOW w AS (PARTITION BY question ORDER BY seq)),
t AS (SELECT *, n >= 100 AND errors >= 5 AS ready FROM l), u AS (SELECT *, CASE WHEN ready AND p + s > lp + 3 * ls THEN 'drift' WHEN ready AND p + s > lp + 2 * ls THEN 'warning' ELSE 'stable' END AS status FROM t),
f AS (SELECT question, min(n) FILTER (status = 'drift') AS stop FROM u GROUP BY 1)
SELECT question, seq, n::BIGINT AS n, errors::BIGINT AS errors, status FROM u JOIN f USING (question) WHERE stop IS NULL OR n <= stop""")
def drift_signal(spark: SparkSession, d: str) -> DataFrame:
    """Warnings up to the first drift of each question, by running sums and the running least."""
    rows = drift(dec(spark, d).where("labelled").select("question", "seq", "ok"), ["question"], "seq", 1 - F.col("ok"), F.floor(F.col("seq") / 20_000))
    return rows.select("question", "seq", "n", "errors", "status")


@query("""WITH RECURSIVE $DEC, r AS (SELECT question, seq, CASE WHEN ok = 1 THEN conf ELSE 1 - conf END AS a, row_number() OVER (PARTITION BY question ORDER BY seq) AS k FROM dec WHERE labelled),
v(question, k, w) AS (SELECT DISTINCT question, 1::BIGINT, 0.5::DOUBLE FROM r UNION ALL
 SELECT v.question, v.k + 1, 0.98 * (v.w * r.a / (v.w * r.a + (1 - v.w) * 0.5)) + 0.01 FROM v JOIN r ON r.question = v.question AND r.k = v.k)
SELECT r.question, r.seq, round(v.w, 6) AS w_stated FROM r JOIN v ON v.question = r.question AND v.k = r.k""")
def hedge_replay(spark: SparkSession, d: str) -> DataFrame:
    """Two forecasters, a coin and the stated confidence; the weight of the second before each label of a question."""
    rows = dec(spark, d).where("labelled").select("question", "seq", F.when(F.col("ok") == 1, F.col("conf")).otherwise(1 - F.col("conf")).alias("p"))
    out = two_forecasters(rows, ["question"], F.floor(F.col("seq") / 20_000), "seq", (N.log_loss(F.lit(0.5)), N.log_loss(F.col("p"))))
    return out.select("question", "seq", F.round("w", 6).alias("w_stated"))


@query("""WITH RECURSIVE $DEC, r AS (SELECT question, seq, CASE WHEN ok = 1 THEN conf ELSE 1 - conf END AS p, CASE WHEN source = 'teacher' THEN CASE WHEN ok = 1 THEN 0.75 ELSE 0.25 END END AS q, row_number() OVER (PARTITION BY question ORDER BY seq) AS k FROM dec WHERE labelled),
v(question, k, a, b, c) AS (SELECT DISTINCT question, 1::BIGINT, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE FROM r UNION ALL
 SELECT question, k + 1, 0.98 * a * 0.5 * m / t + 0.02 / 3::DOUBLE, 0.98 * b * p * m / t + 0.02 / 3::DOUBLE, 0.98 * CASE WHEN q IS NULL THEN c ELSE c * q * m / t END + 0.02 / 3::DOUBLE
 FROM (SELECT v.*, r.p, r.q, a + b + CASE WHEN q IS NULL THEN 0 ELSE c END AS m, a * 0.5 + b * p + CASE WHEN q IS NULL THEN 0 ELSE c * q END AS t FROM v JOIN r ON r.question = v.question AND r.k = v.k))
SELECT r.question, r.seq, round(a, 6) AS w_coin, round(b, 6) AS w_stated, round(c, 6) AS w_teacher FROM r JOIN v ON v.question = r.question AND v.k = r.k""")
def mixture_replay(spark: SparkSession, d: str) -> DataFrame:
    """Three forecasters: a coin, the stated confidence, and one that sleeps unless the teacher spoke; their weights before each label."""
    own = lambda c: F.when(F.col("ok") == 1, c).otherwise(1 - c)
    rows = dec(spark, d).where("labelled").select("question", "seq", own(F.col("conf")).alias("p"), F.when(F.col("source") == "teacher", own(F.lit(0.75))).alias("q"))
    losses = {"coin": N.log_loss(F.lit(0.5)), "stated": N.log_loss(F.col("p")), "teacher": F.when(F.col("q").isNotNull(), N.log_loss(F.col("q")))}
    out = mixture_weights(rows, ["question"], F.floor(F.col("seq") / 20_000), "seq", losses)
    return out.select("question", "seq", *(F.round(F.get("weights", i), 6).alias(f"w_{k}") for i, k in enumerate(losses)))


WEIGHTS = FEAT + """, x AS (SELECT doc_id AS id, unnest(f) AS f, 1 / sqrt(len(f)) AS v FROM feat UNION ALL SELECT doc_id, 'bias', 1 FROM feat),
lab AS (SELECT doc_id AS id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT f, (0.5 - quality) * v AS g FROM x JOIN lab USING (id)), w AS (SELECT f, -0.5 * sum(g) / (sqrt(least(25, sum(g * g))) + 1e-8) AS w FROM g GROUP BY f),
sc AS (SELECT id, sum(w * v) AS z FROM x JOIN w USING (f) GROUP BY id)"""
QUALITY = ["1", "0"]


#: Documents for each task that features are dealt to.
SHARE_OF = 20_000


def _examples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``id, text`` of all documents, and ``text, label, weight`` of those with a quality label: they meet before features are made of them."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, d, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label"), F.lit(1.0).alias("weight"))
    return texts, told(texts, labels, "id")


def _linear(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``id, f, v`` of all documents, and the weights of one pass over the quality labels."""

    def exploded(rows: DataFrame, *keys: str) -> DataFrame:
        # explode_outer: before a plain explode Spark may put a filter on the array's size, for which all features are made a second time
        last = F.array(F.struct(F.lit("bias").alias("f"), F.lit(1.0).alias("v")))
        toks = rows.select(*keys, T.tokens(F.col("text")).alias("t")).select(*keys, T.token_features(F.col("t")).alias("fs"))
        return toks.select(*keys, F.explode_outer(F.concat(F.transform("fs", lambda f: F.struct(f.alias("f"), (1 / F.sqrt(F.size("fs"))).alias("v"))), last)).alias("x")).select(*keys, "x.*")

    texts, examples = _examples(spark, d)
    return exploded(texts, "id"), first_weights(exploded(examples, "label", "weight"), QUALITY)


def _hashed(spark: SparkSession, d: str, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """``hashed_sums`` of all documents by one pass over the quality labels, and the bias' weights ``w``, one row, none without labels."""
    texts, examples = _examples(spark, d)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(texts.count() / SHARE_OF))
    made = lambda rows, *keys: rows.select(*keys, T.tokens(F.col("text")).alias("t")).select(*keys, T.token_hashes(F.col("t")).alias("fs"))
    slopes = examples.select(first_slopes(QUALITY).alias("slopes"), "text")
    bias = first_weights(examples.select("label", "weight", F.lit("bias").alias("f"), F.lit(1.0).alias("v")), QUALITY).select("w")
    return hashed_sums(made(texts, "id"), made(slopes, "slopes"), len(QUALITY), tasks, least), bias


@query(f"WITH {WEIGHTS} SELECT f AS feature, round(w, 6) AS weight FROM w WHERE abs(w) >= 0.05")
def linear_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The features that one pass over the labels gives a weight worth knowing, for the first option."""
    w = _linear(spark, d)[1]
    return w.where(F.abs(F.get("w", 0)) >= 0.05).select(F.col("f").alias("feature"), F.round(F.get("w", 0), 6).alias("weight"))


@query(f"WITH {WEIGHTS} SELECT id AS doc_id, round(exp(z) / (exp(z) + exp(-z)), 6) AS p FROM sc")
def linear_predict(spark: SparkSession, d: str) -> DataFrame:
    """The probability of good quality by those weights."""
    sums, bias = _hashed(spark, d)
    z = sums.groupBy("id").agg(F.array(*(F.sum(f"z{i}") for i in range(len(QUALITY)))).alias("z")).join(F.broadcast(bias))  # one row
    return z.select(F.col("id").alias("doc_id"), F.round(F.get(softmax(F.zip_with("z", "w", lambda a, b: a + b)), 0), 6).alias("p"))


@query(f"WITH {WEIGHTS} SELECT id AS doc_id, round(coalesce(sum(v * v) FILTER (abs(w) >= 0.05), 0) / sum(v * v), 6) AS familiarity FROM x LEFT JOIN w USING (f) WHERE f <> 'bias' GROUP BY id")
def familiarity(spark: SparkSession, d: str) -> DataFrame:
    """The share of each document's evidence that labels have taught something about."""
    sums = _hashed(spark, d, KNOWN)[0].groupBy("id", "size").agg(F.sum("known").alias("known"), F.sum("n").alias("n"))
    shares = sums.where("size > 0").groupBy("id").agg((F.sum(F.col("known") / F.col("size")) / F.sum(F.col("n") / F.col("size"))).alias("familiarity"))
    return shares.select(F.col("id").alias("doc_id"), F.round("familiarity", 6).alias("familiarity"))


@query(f"""WITH {WEIGHTS}, c AS (SELECT id, f, round(v * CASE WHEN z >= 0 THEN 2 * w ELSE -2 * w END, 9) AS c FROM x JOIN w USING (f) JOIN sc USING (id) WHERE f <> 'bias'), s AS (SELECT *, CASE WHEN c > 0 THEN 'for' ELSE 'against' END AS side FROM c WHERE abs(c) > 1e-3)
SELECT id AS doc_id, f AS feature, side, round(c, 3) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY abs(c) DESC, f) <= CASE side WHEN 'for' THEN 6 ELSE 4 END""")
def linear_explanations(spark: SparkSession, d: str) -> DataFrame:
    """What speaks most for and against each document's answer."""
    x, w = _linear(spark, d)
    return linear_reasons(x, w, QUALITY).select(F.col("id").alias("doc_id"), F.col("f").alias("feature"), "side", F.round("c", 3).alias("weight"))


@query(f"""WITH RECURSIVE {FEAT}, r AS (SELECT doc_id AS id, quality, toxic, row_number() OVER (ORDER BY doc_id) AS place FROM documents JOIN labels USING (doc_id)),
l AS (SELECT id, unnest(['quality', 'toxic']) AS question, unnest([quality, toxic]) AS y, (floor(log2(greatest((place - 1) / 32, 0.5))) + 1)::BIGINT AS block FROM r),
x AS MATERIALIZED (SELECT l.*, u.f, u.v FROM l JOIN (SELECT doc_id AS id, unnest(f) AS f, 1 / sqrt(len(f)) AS v FROM feat UNION ALL SELECT doc_id, 'bias', 1 FROM feat) u USING (id)),
t(block, question, f, w, q) AS (SELECT 0::BIGINT, question, f, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT question, f FROM x) UNION ALL
 (WITH p1 AS (SELECT x.question, x.id, x.y, x.block, 1 / (1 + exp(-2 * sum(w * v))) AS p FROM t JOIN x ON x.question = t.question AND x.f = t.f AND x.block = t.block GROUP BY ALL),
  s1 AS (SELECT x.question, x.f, sum((p - p1.y) * v) AS g, count(*) AS n FROM p1 JOIN x ON x.question = p1.question AND x.id = p1.id GROUP BY ALL),
  g1 AS (SELECT t.*, coalesce(g + 1e-4 * w * n, 0) AS g, least(25, q + coalesce(g + 1e-4 * w * n, 0) ** 2) AS q1 FROM t LEFT JOIN s1 ON s1.question = t.question AND s1.f = t.f)
  SELECT block + 1, question, f, w - 0.5 * g / (sqrt(greatest(q1, g * g)) + 1e-8), q1 FROM g1 WHERE block < (SELECT max(block) FROM l)))
SELECT x.question, x.id AS doc_id, x.y::VARCHAR AS label, round(CASE WHEN x.y = 1 THEN 1 / (1 + exp(-2 * sum(w * v))) ELSE 1 - 1 / (1 + exp(-2 * sum(w * v))) END, 6) AS p FROM x JOIN t ON x.question = t.question AND x.f = t.f AND x.block = t.block GROUP BY x.question, x.id, x.y""")
def linear_replay(spark: SparkSession, d: str) -> DataFrame:
    """Test, then train: each labelled document's forecast by the labels of the blocks before its own, for two questions."""
    given = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "quality", "toxic")
    given = given.join(S.placed(given.limit(0), given)[1].select(F.col("entry").alias("id"), "place"), "id")
    given = written(given.select("id", doubling(F.col("place")).alias("block"), "quality", "toxic"), "labels")
    labels = given.select("id", "block", F.lit(1.0).alias("weight"), F.explode(F.array(*(F.struct(F.lit(q).alias("question"), F.col(q).cast("string").alias("label")) for q in ("quality", "toxic")))).alias("l")).select("id", "block", "weight", "l.*")
    places = given.select("id", "block")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(places) if places.count() <= TOLD else places, "id")  # before features are made of them
    toks = texts.select("id", "block", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).select("id", "block", T.token_hashes(F.col("t")).alias("fs"))
    bias = F.struct(F.xxhash64(F.lit("bias")).alias("f"), F.lit(1.0).alias("v"))
    x = toks.select("id", "block", F.explode_outer(F.concat(F.transform("fs", lambda f: F.struct(f.alias("f"), (1 / F.sqrt(F.size("fs"))).alias("v"))), F.array(bias))).alias("x")).select("id", "block", "x.*")
    out = prequential(x, labels, QUALITY, ["question"])
    own = F.when(F.col("label") == "1", F.get("p", 0)).otherwise(F.get("p", 1))
    return out.select("question", F.col("id").alias("doc_id"), "label", F.round(own, 6).alias("p"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windows_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windowed(table(spark, d, "events"), "tumbling").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events, range(0, 2) AS r(k) GROUP BY 1, 2")
def windows_sliding(spark: SparkSession, d: str) -> DataFrame:
    return windowed(table(spark, d, "events"), "sliding").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def windows_session(spark: SparkSession, d: str) -> DataFrame:
    return windowed(table(spark, d, "events"), "session", keys=("user_id",)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))
