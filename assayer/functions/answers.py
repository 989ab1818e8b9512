"""Questions with typed answers: labels brought to option names, teacher distributions, replies of several shapes, public answers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, functions as F

from assayer.functions import numbers as N

#: Words for yes and no, what a question's name may be, the floor of a teacher's distribution.
TRUE_WORDS = ("true", "yes", "1", "evet", "doğru", "dogru", "y", "t")
FALSE_WORDS = ("false", "no", "0", "hayır", "hayir", "yanlış", "yanlis", "n", "f")
NAME = re.compile(r"[A-Za-z0-9_.\-]{1,64}")
TEACHER_FLOOR, STATED = 0.01, 0.8
CONTAINERS = ("", ".answers", ".results", ".questions", ".decisions")
YES_KEYS = ("probability", "p", "value", "noul", "score")


@dataclass(frozen=True)
class Question:
    """A name, a type (choice, score or noul) and 2 to 255 options in order; a noul's are true and false."""

    name: str
    type: str = "choice"
    options: tuple[str, ...] = ("true", "false")
    instructions: str = ""
    descriptions: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, name: str, raw: Mapping[str, Any]) -> Question:
        """A question as a request states it: options as a map to descriptions, as names, or as objects with a name, value or label."""
        kind = str(raw.get("type", "choice")).lower()
        stated = next((raw[k] for k in ("criteria", "options", "levels") if k in raw), None)
        pairs: list[tuple[str, str]] = []
        for item in stated.items() if isinstance(stated, Mapping) else stated if isinstance(stated, (list, tuple)) else ():
            if isinstance(stated, Mapping):
                key, said = item[0], "" if item[1] is None else item[1]
            elif isinstance(item, Mapping):
                key, said = next((item[k] for k in ("name", "value", "label") if item.get(k)), ""), item.get("description", "")
            else:
                key, said = item, ""
            if str(key).strip():
                pairs.append((str(key).strip(), str(said)))
        found = dict(pairs)
        if kind == "noul":
            found = {o: found.get(o, "") for o in ("true", "false")}
        return cls(name, kind, tuple(found), str(raw.get("instructions", "")), {k: v for k, v in found.items() if v})

    def merge(self, other: Question) -> Question:
        """With what a later request states: new options and descriptions of a choice, new instructions; a score's levels are fixed."""
        if other.type != self.type:
            raise ValueError(f"{self.name} is a {self.type} question, not {other.type}")
        more = tuple(o for o in other.options if o not in self.options)
        if more and self.type == "score":
            raise ValueError(f"{self.name}: levels are fixed")
        return replace(self, options=self.options + more, instructions=other.instructions or self.instructions, descriptions={**self.descriptions, **other.descriptions})

    def __post_init__(self) -> None:
        if not NAME.fullmatch(self.name) or self.type not in ("choice", "score", "noul"):
            raise ValueError(f"bad question {self.name!r} of type {self.type!r}")
        if not 2 <= len(self.options) <= 255 or len(set(self.options)) < len(self.options):
            raise ValueError(f"{self.name}: 2 to 255 different options")
        if self.type == "noul" and self.options != ("true", "false"):
            raise ValueError(f"{self.name}: a noul has the options true and false")

    def label(self, value: Column) -> Column:
        """The option that a label names: as written, in other case, or a level's number; a choice may be new; else null."""
        text = F.trim(value.cast("string"))
        low = F.lower(text)
        if self.type == "noul":
            return F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false")
        exact = F.when(text.isin(*self.options), text)
        folded = F.coalesce(*(F.when(low == o.lower(), F.lit(o)) for o in reversed(self.options)))
        if self.type == "choice":
            return F.coalesce(exact, folded, F.when(text != "", text))
        level = text.try_cast("double").try_cast("int")
        return F.coalesce(exact, folded, F.when((level >= 0) & (level < len(self.options)), F.get(F.array(*map(F.lit, self.options)), level)))

    def teacher(self, stated: Column) -> Column:
        """Probabilities in option order from a teacher's map: unknown answers dropped, negatives 0, a floor added; null if nothing is left."""
        known = F.array(*(F.greatest(F.coalesce(F.try_element_at(stated, F.lit(o)), F.lit(0.0)), F.lit(0.0)) for o in self.options))
        floor = TEACHER_FLOOR / len(self.options)
        return F.when(N.total(known) > 0, N.normalized(F.transform(N.normalized(known), lambda p: p + floor)))

    def reply(self, json: Column) -> Column:
        """Probabilities in option order from a JSON reply; null if unreadable.

        The first object under the question's name, at the top or in a container, is read alone.  A noul may give one
        number; else a map by option or its number; else a choice with a confidence, STATED if absent or 0.
        """
        reply = F.try_parse_json(json)
        whole = [F.try_variant_get(reply, f"${c}['{self.name}']", "variant") for c in CONTAINERS]
        node = F.coalesce(*(F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in whole))

        def number(path: str) -> Column:
            """Of a JSON number or boolean, not of text."""
            v = F.try_variant_get(node, path, "variant")
            kind = F.schema_of_variant(v)
            return F.when(kind == "BOOLEAN", F.try_variant_get(node, path, "boolean").cast("double")).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL|BIGINT|INT|SMALLINT|TINYINT)"), F.try_variant_get(node, path, "double"))

        text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING", F.try_variant_get(node, path, "string"))
        found = []
        given = [F.coalesce(number(f"$.probabilities['{o}']"), number(f"$.probabilities['{i}']")) for i, o in enumerate(self.options)]
        by_option = F.array(*(F.coalesce(g, F.lit(0.0)) for g in given))
        if self.type == "noul":
            stated = F.coalesce(*(number(f"$.{k}") for k in YES_KEYS))
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), stated))
            names = F.map_keys(F.from_json(F.try_variant_get(node, "$.probabilities", "string"), "map<string,string>"))
            says_yes = F.exists(names, lambda k: F.lower(k) == "yes")
            yes = F.coalesce(number("$.probabilities.yes"), number("$.probabilities.Yes"), F.lit(0.5))
            found = [F.when(stated.isNotNull(), F.array(p, 1 - p)), F.when(given[0].isNull() & says_yes, F.array(yes, 1 - yes))]
        choice = F.coalesce(F.nullif(text("$.choice"), F.lit("")), text("$.answer"))
        sure = F.coalesce(F.nullif(F.coalesce(number("$.confidence"), text("$.confidence").try_cast("double")), F.lit(0.0)), F.lit(STATED))
        rest = (1 - sure) / (len(self.options) - 1)
        found += [F.when(N.total(by_option) > 0, N.normalized(by_option)), F.when(choice.isin(*self.options), F.array(*(F.when(choice == o, sure).otherwise(rest) for o in self.options)))]
        return F.when(node.isNotNull(), F.coalesce(*found))

    def public(self, probs: Column, answer: Column | None = None) -> Column:
        """What a caller sees, 4 decimals: the answer (the first of the largest if none is given), its confidence, every option's
        probability (a choice's the largest first), a score's expected level, a noul's probability of true."""
        names = F.array(*map(F.lit, self.options))
        answer = F.get(names, N.first_largest(probs) - 1) if answer is None else answer
        none = F.lit(None).cast("double")
        level = F.aggregate(F.zip_with(probs, F.sequence(F.lit(0), F.lit(len(self.options) - 1)), lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
        pairs = F.zip_with(names, probs, lambda o, p: F.struct(o.alias("option"), F.round(p, 4).alias("p")))
        if self.type == "choice":  # ties in option order
            placed = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("d"), i.alias("i"))))
            pairs = F.transform(placed, lambda x: F.get(pairs, x["i"]))
        return F.struct(
            answer.alias("answer"), F.round(F.array_max(probs), 4).alias("confidence"),
            (F.round(level, 4) if self.type == "score" else none).alias("score"),
            (F.round(F.get(probs, 0), 4) if self.type == "noul" else none).alias("probability"),
            pairs.alias("probabilities"),
        )

    def forced(self, public: Column, label: Column) -> Column:
        """A public answer that a rule overrides: confidence 1, a score's level, a noul's 1 or 0; the probabilities stay."""
        out = public.withField("answer", label).withField("confidence", F.lit(1.0))
        if self.type == "score":
            out = out.withField("score", (F.array_position(F.array(*map(F.lit, self.options)), label) - 1).cast("double"))
        if self.type == "noul":
            out = out.withField("probability", F.when(label == "true", 1.0).otherwise(0.0))
        return out
