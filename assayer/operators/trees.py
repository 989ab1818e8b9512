"""Decision-tree statistics as aggregates: split candidates of numbers and categories, the split decision, rules made simple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import numbers as N
from assayer.operators.tables import written

#: Thresholds tried for a number, least share of a branch, confidence and tie of a split.
THRESHOLDS, MIN_BRANCH, DELTA, TIE = 10, 0.01, 1e-7, 0.05


#: Rows a leaf has before it may split.
GRACE = 200


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, within 1e-7, by a rational approximation of the error function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def gain(left: list[Column], right: list[Column], least: float = MIN_BRANCH) -> Column:
    """Information gain of two branches' class weights; null if fewer than two of them hold ``least`` of the weight."""
    both = [a + b for a, b in zip(left, right)]
    total = lambda v: sum(v[1:], v[0])
    n, a, b = total(both), total(left), total(right)
    value = N.entropy(both) - (a * N.entropy(left) + b * N.entropy(right)) / n
    return F.when((a >= least * n) & (b >= least * n), value)


def class_gaussians(rows: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """``keys, label, n, mean, sd, low, high`` of a numeric feature: all that its observer knows."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def numeric_splits(stats: DataFrame, keys: list[str], label: str, classes: list[str]) -> DataFrame:
    """``keys, threshold, merit`` of THRESHOLDS cuts between the least and the greatest value, class weights on each side by their Gaussians."""
    ends = stats.groupBy(*keys).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi")).where("_hi > _lo")
    step = (F.col("_hi") - F.col("_lo")) / (THRESHOLDS + 1)
    cuts = ends.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(THRESHOLDS)), lambda i: F.col("_lo") + step * i)).alias("threshold"))
    rows = stats.join(cuts, keys) if keys else stats.join(F.broadcast(cuts))  # THRESHOLDS rows
    z = (F.col("threshold") - F.col("mean")) / F.greatest("sd", F.lit(1e-12))
    below = F.when(F.col("threshold") < F.col("low"), 0.0).when(F.col("threshold") >= F.col("high"), F.col("n")).otherwise(F.col("n") * normal_cdf(z))
    side = lambda w, c: F.coalesce(F.sum(F.when(F.col(label) == c, w)), F.lit(0.0))
    sums = rows.groupBy(*keys, "threshold").agg(*(side(below, c).alias(f"l_{i}") for i, c in enumerate(classes)), *(side(F.col("n") - below, c).alias(f"r_{i}") for i, c in enumerate(classes)))
    at = range(len(classes))
    return sums.select(*keys, "threshold", gain([F.col(f"l_{i}") for i in at], [F.col(f"r_{i}") for i in at]).alias("merit"))


def nominal_splits(rows: DataFrame, value: str, label: str, classes: list[str]) -> DataFrame:
    """``value, merit, likelihood``: the gain of one value against the rest, and the smoothed P(value | class) in class order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(*(F.count_if(F.col(label) == c).cast("double").alias(f"c_{i}") for i, c in enumerate(classes)))
    at = range(len(classes))
    whole = counts.agg(F.count("*").alias("values"), *(F.sum(f"c_{i}").alias(f"z_{i}") for i in at))
    own, rest = [F.col(f"c_{i}") for i in at], [F.col(f"z_{i}") - F.col(f"c_{i}") for i in at]
    near = F.array(*((F.col(f"c_{i}") + 1) / (F.col(f"z_{i}") + F.col("values")) for i in at))
    return counts.join(F.broadcast(whole)).where("values > 1").select("value", gain(own, rest).alias("merit"), near.alias("likelihood"))  # one row of totals


def split_decision(best: DataFrame, n: Column, classes: int, delta: float = DELTA, tie: float = TIE) -> DataFrame:
    """One row: the best feature, its merit, the runner-up's (0 if alone), the bound, and whether the leaf splits.

    ``best`` has ``feature, merit`` and a column that ``n`` reads, one row for each feature.
    """
    rank = F.row_number().over(Window.orderBy(F.desc("merit"), "feature"))  # as many rows as features
    rows = best.where("merit is not null").withColumns({"_n": n, "_r": rank})
    one = rows.agg(F.max(F.when(F.col("_r") == 1, F.col("feature"))).alias("feature"), F.max(F.when(F.col("_r") == 1, F.col("merit"))).alias("merit"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("merit"))), F.lit(0.0)).alias("second"), F.max("_n").alias("n"))
    bound = N.hoeffding(F.log2(F.lit(float(max(classes, 2)))), delta, F.col("n"))
    return one.withColumn("bound", bound).withColumn("splits", (F.col("merit") > 0) & ((F.col("merit") - F.col("second") > F.col("bound")) | (F.col("bound") < tie)))


def grow(rows: DataFrame, numeric: list[str], nominal: list[str], label: str, classes: list[str], depth: int = 3, delta: float = DELTA, tie: float = TIE) -> DataFrame:
    """``node, depth, n, counts, feature, kind, threshold, value, merit, splits``: a tree grown level by level over all rows.

    A node is named by the branches from the root (``""``): 0 for at most the threshold or the value itself, 1 for the rest; ``counts`` are in class order.
    A level is one round: class Gaussians of every number and counts of every value, by leaf, and the best candidate of each feature; a
    leaf splits by the Hoeffding bound, as ``split_decision`` has it.  Rows find their leaf by the node table, of 2^depth rows at most; a row without
    the feature follows the heavier branch.  Rows without a label are left out; a leaf of one class, or of fewer than GRACE rows, stays one.
    """
    at = rows.select(*(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in nominal), F.col(label).alias("_y"), F.lit("").alias("node")).where("_y is not null")
    places, out = range(len(classes)), None
    count = lambda i: F.count_if(F.col("_y") == classes[i])
    long = lambda names: at.select("node", "_y", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names))).alias("x")).select("node", "_y", "x.*").where("value is not null")
    for level in range(depth + 1):
        leaves = at.groupBy("node").agg(F.count("*").alias("n"), F.array(*map(count, places)).alias("counts")).withColumn("depth", F.lit(level))
        found = []
        if level < depth and numeric:
            cuts = numeric_splits(class_gaussians(long(numeric), ["node", "feature"], "value", "_y"), ["node", "feature"], "_y", classes).where("merit is not null")
            best = cuts.groupBy("node", "feature").agg(F.min(F.struct((-F.col("merit")).alias("m"), "threshold")).alias("b"))
            found.append(best.select("node", "feature", F.lit("number").alias("kind"), F.col("b.threshold").alias("threshold"), F.lit(None).cast("string").alias("value"), (-F.col("b.m")).alias("merit")))
        if level < depth and nominal:
            by = long(nominal).groupBy("node", "feature", "value").agg(*(count(i).cast("double").alias(f"c_{i}") for i in places))
            whole = by.groupBy("node", "feature").agg(*(F.sum(f"c_{i}").alias(f"z_{i}") for i in places))
            merit = gain([F.col(f"c_{i}") for i in places], [F.col(f"z_{i}") - F.col(f"c_{i}") for i in places])
            best = by.join(whole, ["node", "feature"]).withColumn("merit", merit).where("merit is not null").groupBy("node", "feature").agg(F.min(F.struct((-F.col("merit")).alias("m"), "value")).alias("b"))
            found.append(best.select("node", "feature", F.lit("value").alias("kind"), F.lit(None).cast("double").alias("threshold"), F.col("b.value").alias("value"), (-F.col("b.m")).alias("merit")))
        if found:
            rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("merit"), "feature"))  # a row for each feature
            ranked = (found[0].union(found[1]) if len(found) > 1 else found[0]).withColumn("_r", rank)
            first = ranked.where("_r = 1").join(ranked.where("_r = 2").select("node", F.col("merit").alias("_second")), "node", "left").drop("_r")
            seen = F.size(F.filter("counts", lambda c: c > 0))
            bound = N.hoeffding(F.log2(F.greatest(seen, F.lit(2)).cast("double")), delta, F.col("n"))
            clear = (F.col("merit") > 0) & ((F.col("merit") - F.coalesce("_second", F.lit(0.0)) > bound) | (bound < tie))
            table = leaves.join(first, "node", "left").withColumn("splits", F.coalesce(clear & (seen > 1) & (F.col("n") >= GRACE), F.lit(False)))
        else:
            table = leaves.withColumns({"feature": F.lit(None).cast("string"), "kind": F.lit(None).cast("string"), "threshold": F.lit(None).cast("double"), "value": F.lit(None).cast("string"), "merit": F.lit(None).cast("double"), "splits": F.lit(False)})
        table = written(table.select("node", "depth", "n", "counts", *(F.when(F.col("splits"), F.col(c)).alias(c) for c in ("feature", "kind", "threshold", "value", "merit")), "splits"), "nodes")
        out = table if out is None else out.union(table)
        cut = table.where("splits").select("node", "feature", "kind", "threshold", F.col("value").alias("_value"))
        if level == depth or cut.isEmpty():
            break
        of = lambda names: F.coalesce(*(F.when(F.col("feature") == c, F.col(c)) for c in names), F.lit(None))
        low = F.when(F.col("kind") == "number", of(numeric) <= F.col("threshold") if numeric else F.lit(None)).otherwise(of(nominal) == F.col("_value") if nominal else F.lit(None))
        met = at.join(F.broadcast(cut), "node").withColumn("_b", F.when(low, 0).when(~low, 1))  # 2^level rows
        heavy = written(met.groupBy("node").agg(F.when(F.count_if(F.col("_b") == 0) >= F.count_if(F.col("_b") == 1), 0).otherwise(1).alias("_h")), "branches")
        at = met.join(F.broadcast(heavy), "node").select(*numeric, *nominal, "_y", F.concat("node", F.coalesce("_b", "_h").cast("string")).alias("node"))
    return out


def rules(nodes: DataFrame, classes: list[str]) -> DataFrame:
    """``rule, prediction, confidence, support, node``: each leaf of ``grow`` as one rule, its conditions made simple and joined by `` and ``.

    Ties of classes go to the first.  Sort by support for the rules that matter most.
    """
    leaves = nodes.where("not splits and n > 0")
    steps = leaves.where("node <> ''").select("node", F.explode(F.sequence(F.lit(1), F.length("node"))).alias("at")).select("node", "at", F.expr("substring(node, 1, at - 1)").alias("_parent"), F.expr("substring(node, at, 1)").alias("_b"))
    cut = nodes.where("splits").select(F.col("node").alias("_parent"), "feature", "kind", "threshold", F.col("value").alias("_value"))
    op = F.when(F.col("kind") == "number", F.when(F.col("_b") == "0", "<=").otherwise(">")).otherwise(F.when(F.col("_b") == "0", "==").otherwise("!="))
    value = F.when(F.col("kind") == "number", F.round("threshold", 6).cast("string")).otherwise(F.col("_value"))
    each = simplified(steps.join(cut, "_parent").select("node", "at", "feature", op.alias("op"), value.alias("value")), ["node"])
    text = each.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "feature", "op", "value"))), " and ").alias("rule"))
    most = F.array_max("counts")
    label = F.get(F.array(*map(F.lit, classes)), N.first_largest(F.col("counts")) - 1)
    return leaves.join(text, "node", "left").select(F.coalesce("rule", F.lit("")).alias("rule"), label.alias("prediction"), (most / F.col("n")).alias("confidence"), F.col("n").alias("support"), "node")


def simplified(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, feature, op, value``: bounds on a feature merged, an equality before inequalities, several of these as ``not_in``.

    ``conditions`` has ``keys, at`` (the order), ``feature, op, value`` (text; numbers for bounds).
    """
    number = F.col("value").try_cast("double")
    of = lambda op, x: F.when(F.col("op") == op, x)
    merged = conditions.groupBy(*keys, "feature").agg(
        F.max(of(">", number)).alias("lower"), F.min(of("<=", number)).alias("upper"), F.max_by(of("==", F.col("value")), of("==", F.col("at"))).alias("equal"),
        F.array_sort(F.collect_set(of("!=", F.col("value")))).alias("others"),
    )
    item = lambda when, op, value: F.when(when, F.struct(op.alias("op"), value.alias("value")))
    unequal = F.col("equal").isNull() & (F.size("others") > 0)
    found = F.array(
        item(F.col("lower").isNotNull(), F.lit(">"), F.col("lower").cast("string")),
        item(F.col("upper").isNotNull(), F.lit("<="), F.col("upper").cast("string")),
        item(F.col("equal").isNotNull(), F.lit("=="), F.col("equal")),
        item(unequal, F.when(F.size("others") > 1, "not_in").otherwise("!="), F.array_join("others", ",")),
    )
    return merged.select(*keys, "feature", F.explode(F.array_compact(found)).alias("x")).select(*keys, "feature", "x.*")
