"""The decision contract: thresholds within a risk budget, expected costs, answer or abstain, replay of a policy on a log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.numbers import first_largest, wilson_upper
from assayer.operators.running import by_level, running

#: Fixed values of the contract.
MIN_LABELS, MIN_SUPPORT, NEVER, DEFAULT_THRESHOLD = 30, 10, 1.01, 0.6
#: Of escalation-aware decisions: teacher labels, width of the neighbourhood, pseudo-observations.
MIN_TEACHER, LOCAL, PRIOR = 20, 0.1, 10


def budget_threshold(labelled: DataFrame, keys: list[str], budget: float, conf: str = "conf", ok: str = "ok") -> DataFrame:
    """``keys, labels, threshold``: the lowest confidence at which the upper bound of the error above it is within ``budget``.

    Equal confidences are judged together.  Null under MIN_LABELS labels; NEVER if no level with MIN_SUPPORT labels qualifies.
    """
    levels = by_level(labelled, keys, conf, {"n": F.lit(1), "errors": 1 - F.col(ok)})
    fits = (F.col("upto_n") >= MIN_SUPPORT) & (wilson_upper(F.col("upto_errors"), F.col("upto_n")) <= budget)
    out = levels.groupBy(*keys).agg(F.sum("n").alias("labels"), F.min(F.when(fits, F.col(conf))).alias("_t"))
    return out.select(*keys, "labels", F.when(F.col("labels") >= MIN_LABELS, F.coalesce("_t", F.lit(NEVER))).alias("threshold"))


def expected_threshold(served: DataFrame, keys: list[str], budget: float, conf: str = "conf", ok: str = "ok", labelled: str = "labelled") -> DataFrame:
    """``keys, threshold``: as ``budget_threshold``, of the stated error of all served answers, corrected by the mean residual of the labelled ones."""
    hit = F.col(labelled).cast("int")
    levels = by_level(served, keys, conf, {"n": F.lit(1), "stated": 1 - F.col(conf), "m": hit, "residual": hit * ((1 - F.col(ok)) - (1 - F.col(conf)))})
    risk = F.col("upto_stated") / F.col("upto_n") + F.when(F.col("upto_m") >= MIN_SUPPORT, F.col("upto_residual") / F.col("upto_m")).otherwise(0.0)
    fits = (F.col("upto_m") >= MIN_SUPPORT) & (risk <= budget)
    out = levels.groupBy(*keys).agg(F.sum("m").alias("labels"), F.min(F.when(fits, F.col(conf))).alias("_t"))
    return out.select(*keys, "labels", F.when(F.col("labels") >= MIN_LABELS, F.coalesce("_t", F.lit(NEVER))).alias("threshold"))


def expected_costs(probs: Column, costs: list[list[float]]) -> Column:
    """The expected cost of each answer: ``costs[answer][truth]`` weighed by the probabilities, in option order."""
    term = lambda row: sum((F.get(probs, i) * c for i, c in enumerate(row)), F.lit(0.0))
    return F.array(*(term(row) for row in costs))


def chow_threshold(cost_wrong: float, cost_abstain: float) -> float:
    """Answer if the expected cost of a wrong answer is below that of abstaining."""
    return max(0.0, 1 - cost_abstain / cost_wrong) if cost_wrong > 0 else 0.0


@dataclass(frozen=True)
class Policy:
    """What may set the threshold; the strictest wins, and ``abstain_threshold`` counts if nothing else does.

    ``cost_matrix`` has costs by answer and truth; absent ones are 0 if right, else ``cost_wrong`` (1).  ``risk_budget`` takes its
    threshold from a column, as ``budget_threshold`` or ``expected_threshold`` give it.  ``requested`` overrides all.
    """

    abstain_threshold: float = DEFAULT_THRESHOLD
    risk_budget: float | None = None
    risk_budget_mode: str = "guaranteed"
    cost_wrong: float | None = None
    cost_abstain: float | None = None
    cost_matrix: Mapping[str, Mapping[str, float]] | None = None
    escalation_aware: bool = False
    requested: float | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.abstain_threshold <= 1:
            raise ValueError("abstain_threshold is from 0 to 1")
        if self.risk_budget is not None and not 0 < self.risk_budget < 1:
            raise ValueError("risk_budget is between 0 and 1")
        if self.risk_budget_mode not in ("guaranteed", "expected"):
            raise ValueError("risk_budget_mode is guaranteed or expected")
        if self.cost_wrong is not None and self.cost_wrong <= 0 or self.cost_abstain is not None and self.cost_abstain < 0:
            raise ValueError("costs are positive")
        if any(c < 0 for row in (self.cost_matrix or {}).values() for c in row.values()):
            raise ValueError("costs are not negative")

    def matrix(self, options: Sequence[str]) -> list[list[float]]:
        """Costs by answer and truth, in option order."""
        if unknown := {o for a, row in (self.cost_matrix or {}).items() for o in (a, *row)} - set(options):
            raise ValueError(f"cost_matrix: {sorted(unknown)} are no options")
        wrong = 1.0 if self.cost_wrong is None else self.cost_wrong
        return [[float((self.cost_matrix or {}).get(a, {}).get(y, 0.0 if a == y else wrong)) for y in options] for a in options]

    def decide(self, probs: Column, options: Sequence[str], tau: Column | None = None) -> Column:
        """A struct ``answer, threshold, rule, abstain, expected_cost`` for probabilities in option order; ``tau`` is the risk
        budget's threshold, null while labels are too few."""
        names = F.array(*map(F.lit, options))
        null = F.lit(None).cast("double")
        best, sure = F.get(names, first_largest(probs) - 1), F.array_max(probs)

        def result(answer: Column, threshold: Column, rule: Column, abstain: Column, cost: Column) -> Column:
            return F.struct(answer.alias("answer"), threshold.alias("threshold"), rule.alias("rule"), abstain.alias("abstain"), cost.alias("expected_cost"))

        if self.requested is not None:
            return result(best, F.lit(float(self.requested)), F.lit("request_threshold"), sure < self.requested, null)
        answer, share, cost, dear = best, sure, null, F.lit(False)
        thresholds, rules = [], []
        if self.cost_matrix:
            costs = expected_costs(probs, self.matrix(options))
            cost = F.array_min(costs)
            place = F.array_position(costs, cost).cast("int") - 1
            answer, share = F.get(names, place), F.get(probs, place)
            if self.cost_abstain is not None:
                dear = cost > self.cost_abstain
            rules.append(F.lit("cost_matrix"))
        elif self.cost_wrong and self.cost_abstain is not None:
            thresholds.append(F.lit(chow_threshold(self.cost_wrong, self.cost_abstain)))
            cost = (1 - sure) * self.cost_wrong
            rules.append(F.lit("costs"))
        if self.risk_budget:
            tau = null if tau is None else tau
            thresholds.append(tau)
            rules.append(F.when(tau.isNull(), "risk_budget_warming_up").otherwise("risk_budget" if self.risk_budget_mode == "guaranteed" else "risk_budget_expected"))
        strictest = F.greatest(*thresholds, null) if thresholds else null
        if not self.cost_matrix:
            rules.append(F.when(strictest.isNull(), "threshold"))
            strictest = F.coalesce(strictest, F.lit(float(self.abstain_threshold)))
        return result(answer, strictest, F.concat_ws("+", *rules), dear | F.coalesce(share < strictest, F.lit(False)), cost)

    def escalating(self, decision: Column, probs: Column, options: Sequence[str], teacher: Column, measured: Column) -> Column:
        """``decision`` revised by who answers better: the teacher with its accuracy, null while unknown, or the student with what its
        confidence has been worth.  Explicit costs and requests price that already."""
        if not self.escalation_aware or self.requested is not None or self.cost_matrix or self.cost_abstain is not None:
            return decision
        known = teacher.isNotNull()
        answers = known & decision["abstain"] & (measured >= teacher)
        asks = known & ~decision["abstain"] & (decision["rule"] == "threshold") & (measured < teacher)
        rule = F.when(answers | asks, F.concat(decision["rule"], F.lit("+escalation_aware"))).otherwise(decision["rule"])
        abstain = F.when(answers, False).when(asks, True).otherwise(decision["abstain"])
        return decision.withField("rule", rule).withField("abstain", abstain)


def escalates(escalate: Column, mode: Column, abstains: Column) -> Column:
    """Whether the teacher is asked: by a request (always, never, auto), and for auto by the question's mode (always, off, on_abstain)."""
    return (escalate == "always") | (escalate == "auto") & ((mode == "always") | (mode == "on_abstain") & abstains)


def policy_versions(changes: DataFrame, keys: list[str], at: str, settings: list[str]) -> DataFrame:
    """Each real change of a policy with its ``version``, from 1, and ``until``, when the next one came: changes that change nothing are dropped."""
    order = Window.partitionBy(*keys).orderBy(at)  # a question's policy changes by hand
    now = F.struct(*settings)
    rows = changes.withColumn("_last", F.lag(now).over(order)).where(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(now)).drop("_last")
    return rows.withColumns({"version": F.row_number().over(order).cast("long"), "until": F.lead(at).over(order)})


def replay_policy(answered: DataFrame, keys: list[str], policy: Policy, options: Sequence[str], probs: str = "probs", label: str = "label", tau: Column | None = None) -> DataFrame:
    """What a policy would have done on logged probabilities and labels: ``keys, n, answered, coverage, wrong, risk, cost, cost_each``.

    A wrong answer costs its cell of the matrix, else ``cost_wrong``; costs are null for a policy without any.
    """
    names = F.array(*map(F.lit, options))
    rows = answered.where(F.col(label).isNotNull()).withColumn("_d", policy.decide(F.col(probs), options, tau))
    gave, wrong = ~F.col("_d.abstain"), F.col("_d.answer") != F.col(label)
    if policy.cost_matrix:
        cells = F.array(*(F.array(*map(F.lit, row)) for row in policy.matrix(options)))
        place = lambda c: (F.array_position(names, c) - 1).cast("int")
        price = F.coalesce(F.get(F.get(cells, place(F.col("_d.answer"))), place(F.col(label))), F.lit(1.0 if policy.cost_wrong is None else float(policy.cost_wrong)))
    else:
        price = F.lit(float(policy.cost_wrong or 0.0))
    cost = F.when(gave & wrong, price).when(gave, 0.0).otherwise(float(policy.cost_abstain or 0.0))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(gave).alias("answered"), F.count_if(gave & wrong).alias("wrong"), F.sum(cost).alias("cost"))
    if policy.cost_matrix is None and policy.cost_wrong is None:
        out = out.withColumn("cost", F.lit(None).cast("double"))
    return out.select(*keys, "n", "answered", (F.col("answered") / F.col("n")).alias("coverage"), "wrong", F.when(F.col("answered") > 0, F.col("wrong") / F.col("answered")).alias("risk"), "cost", (F.col("cost") / F.col("n")).alias("cost_each"))


def replay(answered: DataFrame, keys: list[str], abstain: Column, ok: Column, cost_wrong: float = 1.0, cost_abstain: float = 0.0) -> DataFrame:
    """As ``replay_policy`` where only rightness was logged: ``keys, n, coverage, risk, cost, cost_each``."""
    gave = F.when(~abstain, 1).otherwise(0)
    wrong = F.when(~abstain & (ok == 0), 1).otherwise(0)
    out = answered.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(gave).alias("_g"), F.sum(wrong).alias("_w"))
    cost = F.col("_w") * cost_wrong + (F.col("n") - F.col("_g")) * cost_abstain
    return out.select(*keys, "n", (F.col("_g") / F.col("n")).alias("coverage"), F.when(F.col("_g") > 0, F.col("_w") / F.col("_g")).alias("risk"), cost.alias("cost"), (cost / F.col("n")).alias("cost_each"))


def measured_accuracy(labelled: DataFrame, keys: list[str], conf: str = "conf", ok: str = "ok", width: float = LOCAL) -> DataFrame:
    """``keys, conf, near, accuracy`` for each stated confidence: of the labels within ``width``, shrunk to it by PRIOR observations.

    Counted by level first, then as a difference of two running sums by blocks of confidence, so no task holds a key's levels.
    """
    levels = labelled.groupBy(*keys, conf).agg(F.count("*").alias("n"), F.sum(ok).alias("k")).withColumn("x", F.round(F.col(conf) * 1_000_000).cast("long"))
    reach = int(width * 1_000_000)
    none = F.lit(0).cast("long")
    # marks stand among the levels: sums up to the far end, less those before the near end
    marks = lambda shift, sign: levels.select(*keys, conf, (F.col("x") + shift).alias("x"), none.alias("n"), none.alias("k"), F.lit(sign).alias("sign"))
    rows = levels.select(*keys, conf, "x", "n", "k", F.lit(0).alias("sign")).unionByName(marks(reach, 1)).unionByName(marks(-reach - 1, -1))
    run = running(rows, keys, F.floor(F.col("x") / 20_000), [F.asc("x"), F.asc(F.abs("sign"))], {"upto_n": F.col("n"), "upto_k": F.col("k")}).where("sign <> 0")
    out = run.groupBy(*keys, conf).agg(F.sum(F.col("sign") * F.col("upto_n")).alias("near"), F.sum(F.col("sign") * F.col("upto_k")).alias("right"))
    return out.select(*keys, conf, "near", ((F.col("right") + PRIOR * F.col(conf)) / (F.col("near") + PRIOR)).alias("accuracy"))
