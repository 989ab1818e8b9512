"""Expert rules compiled to one projection: conditions on columns, rules by priority, first match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "in", "not_in", "contains", "is_missing")


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    value: object = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")

    def column(self, df: DataFrame) -> Column:
        """True where the condition holds; a null value meets ``is_missing`` alone.

        Equality and order compare numbers if both sides are numbers, else text; a boolean is never a number.
        """
        x, kind = F.col(f"`{self.feature}`"), dict(df.dtypes)[self.feature]
        if self.op == "is_missing":
            return x.isNull()
        text = x.cast("string")
        number = F.lit(None).cast("double") if kind == "boolean" else text.try_cast("double")

        def equal(v: object) -> Column:
            try:
                wanted = None if isinstance(v, bool) else float(v)  # type: ignore[arg-type]
            except (TypeError, ValueError):
                wanted = None
            same = text == F.lit(str(v).lower() if isinstance(v, bool) else str(v))
            return same if wanted is None else F.coalesce(number == F.lit(wanted), same)

        values = self.value if isinstance(self.value, (list, tuple)) else [s.strip() for s in str(self.value).split(",")]
        if self.op in ("==", "!="):
            out = equal(self.value) if self.op == "==" else ~equal(self.value)
        elif self.op in ("in", "not_in"):
            found = reduce(Column.__or__, [equal(v) for v in values])
            out = found if self.op == "in" else ~found
        elif self.op == "contains":
            out = F.contains(F.lower(text), F.lit(str(self.value).lower()))
        else:
            try:
                bound = F.lit(None if isinstance(self.value, bool) else float(self.value)).cast("double")  # type: ignore[arg-type]
            except (TypeError, ValueError):
                bound = F.lit(None).cast("double")
            out = {">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound}[self.op]
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    decision: str
    conditions: Sequence[Condition]
    priority: int = 0
    enabled: bool = True
    id: str = ""

    def __post_init__(self) -> None:
        if not self.decision or not self.conditions:
            raise ValueError(f"rule {self.name!r} needs a decision and a condition")

    def column(self, df: DataFrame) -> Column:
        return reduce(Column.__and__, [c.column(df) for c in self.conditions])


def first_match(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``rule`` and ``decision`` of the first enabled rule that holds: highest priority, then the order given; null if none."""
    ordered = sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)
    hit = F.coalesce(F.lit(None).cast("int"), *(F.when(r.column(df), F.lit(i)) for i, r in enumerate(ordered)))
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("_hit")) if ordered else F.lit(None).cast("string")
    return df.withColumn("_hit", hit).withColumns({"rule": pick([r.name for r in ordered]), "decision": pick([r.decision for r in ordered])}).drop("_hit")


def rule_hits(old: Sequence[tuple[str, int]], matched: DataFrame) -> DataFrame:
    """``rule, hits``: the decisions of each rule, added to what was counted under its id before the rules were set anew."""
    spark = matched.sparkSession
    before = spark.createDataFrame(list(old), "rule string, before long")
    now = matched.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))
    return now.join(F.broadcast(before), "rule", "full").select("rule", (F.coalesce("n", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("hits"))


def forced_by_rules(answers: DataFrame, rules: Sequence[Rule], options: Sequence[str], text: Column | None = None) -> DataFrame:
    """``answers`` (with ``answer, confidence, abstain, source``) after the rules: the first that holds decides if its decision is
    among the ``options`` asked for, with confidence 1 and never abstaining.  Conditions may read ``$text``, the rendered state."""
    rows = answers if text is None else answers.withColumn("$text", text)
    found = first_match(rows, rules)
    hit = F.coalesce(F.col("decision").isin(*options), F.lit(False))
    out = found.withColumns({
        "answer": F.when(hit, F.col("decision")).otherwise(F.col("answer")),
        "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
        "abstain": ~hit & F.col("abstain"),
        "source": F.when(hit, "rule").otherwise(F.col("source")),
        "rule": F.when(hit, F.col("rule")),
    })
    return out.drop("decision", "$text")
