"""The append-only feedback log: active events by anti-join, undo, snapshots, training sets and capacities as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators.running import running

#: Fixed values.
KEEP_AUTOMATIC, SNAPSHOT_EVERY, MOST_UNDONE, BATCH = 10, 250, 1000, 1000
RANKS = {"human": 3, "system": 2, "dataset": 2, "teacher": 1}


def active(events: DataFrame, retractions: DataFrame) -> DataFrame:
    """Events whose latest retraction operation, if any, isn't ``retract``."""
    latest = retractions.groupBy("event_id").agg(F.max_by("op", "at").alias("op"))
    return events.join(latest.where("op = 'retract'"), "event_id", "left_anti")


def newest(events: DataFrame, retractions: DataFrame, n: int, source: str | None = None) -> DataFrame:
    """The newest ``n`` active events (MOST_UNDONE at most), of one source if given: what an undo of the last ``n`` takes back."""
    rows = active(events, retractions)
    return (rows.where(F.col("source") == source) if source else rows).orderBy(F.desc("event_id")).limit(min(n, MOST_UNDONE))


def training_rows(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each of ``keys``: people before datasets before teachers, then the latest.  A hot key is combined before the shuffle."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("source")], F.lit(0))
    best = events.groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), "event_id", F.struct(*[c for c in events.columns if c not in (*keys, "event_id")]).alias("row"))).alias("b"))
    return best.select(*keys, "b.event_id", "b.row.*")


def kept_snapshots(snapshots: DataFrame, keep: int = KEEP_AUTOMATIC) -> DataFrame:
    """The newest ``keep`` automatic snapshots of each question, and all others."""
    automatic = snapshots.where("note = 'automatic'")
    order = Window.partitionBy("question").orderBy(F.desc("version"))
    return automatic.withColumn("_r", F.row_number().over(order)).where(f"_r <= {keep}").drop("_r").unionByName(snapshots.where("note is distinct from 'automatic'"))


def latest_settings(settings: DataFrame) -> DataFrame:
    """The last written value of each key."""
    return settings.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def setting(settings: DataFrame, wanted: DataFrame, default: Column) -> DataFrame:
    """``key, value`` of the wanted keys, ``default`` where none was written."""
    return wanted.join(latest_settings(settings), "key", "left").select("key", F.coalesce("value", default).alias("value"))


def latest_rows(versions: DataFrame, key: str, at: str, made: str = "created_at") -> DataFrame:
    """An upsert's view of an append-only table: the last row of each ``key``, with the time ``made`` of its first."""
    rest = [c for c in versions.columns if c not in (key, made)]
    best = versions.groupBy(key).agg(F.min(made).alias(made), F.max_by(F.struct(*rest), at).alias("_row"))
    return best.select(key, made, "_row.*")


def decision_rows(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two appends of a batch of decisions: ``decision_id, created_at, state`` and one row for each answer.

    ``answers`` is a map from a question to a struct ``answer, confidence, abstain, source``.
    """
    rows = decisions.select("decision_id", F.explode("answers").alias("question", "a"), "created_at")
    return decisions.select("decision_id", "created_at", "state"), rows.select("decision_id", "question", "created_at", "a.*")


def with_labels(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """``answers`` with ``label``, the last one given to a decision's question; null while pending."""
    last = labels.groupBy("decision_id", "question").agg(F.max_by("label", "at").alias("label"))
    return answers.join(last, ["decision_id", "question"], "left")


def decisions_with_labels(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """``decisions`` with a map from question to answer and one to label."""
    each = answers.groupBy("decision_id").agg(F.collect_list(F.struct("question", "answer", "label")).alias("_q"))  # a decision's questions
    pick = lambda c: F.map_from_entries(F.transform("_q", lambda q: F.struct(q["question"], q[c])))
    return decisions.join(each, "decision_id", "left").withColumns({"answers": pick("answer"), "labels": pick("label")}).drop("_q")


def first_feedback(feedback: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feedback that counts, with ``correct`` against what was served, and what conflicts: an answer is labelled once.

    Feedback on what wasn't asked is in neither.
    """
    keys = ["decision_id", "question"]
    first = feedback.groupBy(*keys).agg(F.min("at").alias("at"), F.min_by("label", "at").alias("label"))
    counted = first.join(answers.select(*keys, "answer"), keys).withColumn("correct", F.col("answer") == F.col("label"))
    return counted, feedback.join(counted.select(*keys, F.col("at").alias("_at")), keys).where("at > _at").drop("_at")


def with_event_ids(batch: DataFrame, order: str, block: Column, last_id: int = 0) -> DataFrame:
    """A batch to append, with ``event_id`` from the log's last one on, in ``order``; numbered by blocks, so no task holds the batch."""
    return running(batch, [], block, [F.asc(order)], {}).withColumn("event_id", F.col("rank") + last_id).drop("rank")


def without_question(table: DataFrame, deleted: DataFrame, column: str = "question", at: str | None = None) -> DataFrame:
    """A table after questions were deleted; with ``at``, rows written after a deletion stay: the question began anew."""
    last = deleted.groupBy(F.col("question").alias(column)).agg(F.max("at").alias("_at"))
    if at is None:
        return table.join(last, column, "left_anti")
    return table.join(last, column, "left").where(F.col("_at").isNull() | (F.col(at) > F.col("_at"))).drop("_at")


def registry(changes: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """The state of each registered thing: of every field the last value written, null fields of a change leave it as it was."""
    fields = [c for c in changes.columns if c not in (key, at)]
    return changes.groupBy(key).agg(F.min(at).alias("created_at"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in fields))


def latest_by_status(registered: DataFrame, key: str = "id") -> DataFrame:
    """``status, id``: the newest thing of each status."""
    return registered.groupBy("status").agg(F.max_by(key, F.struct("created_at", key)).alias(key))


def snapshot_marks(log: DataFrame, keys: list[str], batch: str, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """``keys, batch, labels``: the batches after which a question's labels have passed another multiple of ``every``."""
    sums = log.groupBy(*keys, batch).agg(F.count("*").alias("n"))
    now = Window.partitionBy(*keys).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)  # one row for each batch
    rows = sums.withColumn("labels", F.sum("n").over(now))
    return rows.where(F.floor(F.col("labels") / every) > F.floor((F.col("labels") - F.col("n")) / every)).select(*keys, batch, "labels")


def page(table: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows of a listing, ``limit`` after ``offset``."""
    return table.orderBy(*order).offset(offset).limit(limit)


def batches(events: DataFrame, after: int = 0, size: int = BATCH) -> DataFrame:
    """The next ``size`` events after a position, in order: what a reader of the log takes at a time."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(size)


def balanced(entries: DataFrame, label: str, order: str, capacity: int) -> DataFrame:
    """What is left after the oldest entry of the most frequent label was dropped until ``capacity`` are: the newest of each label.

    Levels of the labels are cut down to one height, so a label's share depends on the counts alone; one row for each label is
    summed up, and Spark keeps at most ``capacity`` rows of a label before the shuffle.
    """
    counts = entries.groupBy(label).agg(F.count("*").alias("n"))
    each = counts.agg(F.sort_array(F.collect_list(F.struct("n", label))).alias("all"))  # one row for each label
    total = lambda k: F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], k))
    # the height: halve the room 40 times
    search = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).cast("long").alias("lo"), F.lit(capacity).cast("long").alias("hi")), lambda s, _: _halved(s, total, capacity))
    one = each.select("all", search["lo"].alias("cap")).withColumn("spare", F.lit(capacity) - total(F.col("cap")))
    over = F.array_sort(F.transform(F.filter("all", lambda x: x["n"] > F.col("cap")), lambda x: x[label]))
    keeps = one.withColumn("_over", over).select(F.explode("all").alias("x"), "cap", "spare", "_over").select(F.col(f"x.{label}").alias(label), (F.least("x.n", "cap") + F.when(F.array_position("_over", F.col(f"x.{label}")).between(1, F.col("spare")), 1).otherwise(0)).alias("_keep"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(order)))
    newest_ = entries.withColumn("_r", rank).where(F.col("_r") <= capacity)
    return newest_.join(F.broadcast(keeps), label).where("_r <= _keep").drop("_r", "_keep")


def _halved(s: Column, total, capacity: int) -> Column:
    middle = ((s["lo"] + s["hi"] + 1) / 2).cast("long")
    fits = total(middle) <= capacity
    return F.struct(F.when(fits, middle).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(F.greatest(middle - 1, s["lo"])).alias("hi"))
