"""Ordered rules as data: conditions over folded fields and earlier decisions, compiled to Column expressions, and to SQL for checking.

Ladders are decided in turn, so a rule may ask what earlier ones said. Each row is decided in one pass of built-in expressions: no
join, no shuffle, no Python. Folded fields are padded with spaces, so a phrase is found at token boundaries only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import computed


@dataclass(frozen=True)
class Has:
    """One of the phrases stands in the field; with absent, none does. Null fields hold nothing."""

    field: str
    phrases: tuple[str, ...]
    absent: bool = False

    def column(self) -> Column:
        found = F.coalesce(reduce(lambda a, b: a | b, [F.contains(F.col(self.field), F.lit(f" {p} ")) for p in self.phrases]), F.lit(False))
        return ~found if self.absent else found

    def sql(self) -> str:
        found = "coalesce(" + " OR ".join(f"contains({self.field}, ' {p} ')" for p in self.phrases) + ", false)"
        return f"NOT {found}" if self.absent else found

    def evidence(self) -> Column:
        return F.coalesce(*[F.when(F.contains(F.col(self.field), F.lit(f" {p} ")), p) for p in self.phrases])

    def evidence_sql(self) -> str:
        return "CASE " + " ".join(f"WHEN contains({self.field}, ' {p} ') THEN '{p}'" for p in self.phrases) + " END"


@dataclass(frozen=True)
class Said:
    """An earlier decision, or any other column, is one of the values; with never, none of them (a null is none)."""

    name: str
    values: tuple[str, ...]
    never: bool = False

    def column(self) -> Column:
        found = F.coalesce(F.col(self.name).isin(*self.values), F.lit(False))
        return ~found if self.never else found

    def sql(self) -> str:
        found = f"coalesce({self.name} IN ({', '.join(repr(v) for v in self.values)}), false)"
        return f"NOT {found}" if self.never else found


@dataclass(frozen=True)
class Holds:
    """A condition in SQL that both engines read."""

    text: str

    def column(self) -> Column:
        return F.coalesce(F.expr(self.text), F.lit(False))

    def sql(self) -> str:
        return f"coalesce({self.text}, false)"


@dataclass(frozen=True)
class Rule:
    """The value that holds where all conditions do. Its evidence is the first phrase found by the first condition on a field."""

    value: str
    given: tuple[Has | Said | Holds, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.given])

    def sql(self) -> str:
        return " AND ".join(f"({c.sql()})" for c in self.given)

    def witness(self) -> Has | None:
        return next((c for c in self.given if isinstance(c, Has) and not c.absent), None)


@dataclass(frozen=True)
class Ladder:
    """One value: that of the first rule that holds, else the default."""

    name: str
    rules: tuple[Rule, ...]
    default: str | None = "unknown"

    def columns(self) -> dict[str, Column]:
        value, proof = F.lit(self.default), F.lit(None).cast("string")
        for rule in reversed(self.rules):
            own = rule.column()
            value = F.when(own, rule.value).otherwise(value)
            proof = F.when(own, rule.witness().evidence() if rule.witness() else F.lit(None)).otherwise(proof)
        return {self.name: value, f"{self.name}_evidence": proof}

    def sqls(self) -> dict[str, str]:
        value = "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.value}'" for r in self.rules) + (f" ELSE '{self.default}'" if self.default else "") + " END"
        proof = "CASE " + " ".join(f"WHEN {r.sql()} THEN {r.witness().evidence_sql() if r.witness() else 'NULL'}" for r in self.rules) + " END"
        return {self.name: value, f"{self.name}_evidence": proof}


@dataclass(frozen=True)
class Several:
    """All values whose rules hold, in the rules' order, each once."""

    name: str
    rules: tuple[Rule, ...]

    def columns(self) -> dict[str, Column]:
        return {self.name: F.array_distinct(F.array_compact(F.array(*[F.when(r.column(), r.value) for r in self.rules])))}

    def sqls(self) -> dict[str, str]:
        names = list(dict.fromkeys(r.value for r in self.rules))
        tests = {v: " OR ".join(f"({r.sql()})" for r in self.rules if r.value == v) for v in names}
        parts = ", ".join(f"CASE WHEN {t} THEN '{v}' END" for v, t in tests.items())
        return {self.name: f"list_filter([{parts}], lambda x: x IS NOT NULL)"}


def decided(rows: DataFrame, steps: Sequence[Ladder | Several]) -> DataFrame:
    """rows with the columns of each step; a step sees those of the ones before."""
    for step in steps:
        rows = rows.withColumns(step.columns())
    return rows


def decided_sql(base: str, steps: Sequence[Ladder | Several]) -> str:
    """The same over a SELECT, as nested SELECTs."""
    for step in steps:
        base = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.sqls().items())} FROM ({base})"
    return base


def _tag(name: str):
    return lambda value: F.struct(F.lit(name).alias("dimension"), value.alias("value"), F.lit(None).cast("string").alias("evidence"))


def tags(rows: DataFrame, key: list[str], steps: Sequence[Ladder | Several], confidence: Column) -> DataFrame:
    """key, dimension, value, confidence and evidence of decided rows, a row a value; a step without any says `unknown`."""
    each = []
    for step in steps:
        if isinstance(step, Ladder):
            each.append(F.array(F.struct(F.lit(step.name).alias("dimension"), F.coalesce(F.col(step.name), F.lit("unknown")).alias("value"), F.col(f"{step.name}_evidence").alias("evidence"))))
        else:
            own = F.when(F.size(step.name) > 0, F.col(step.name)).otherwise(F.array(F.lit("unknown")))
            each.append(F.transform(own, _tag(step.name)))
    listed = computed(rows.select(*key, confidence.alias("confidence"), F.concat(*each).alias("__tags")))
    return listed.select(*key, "confidence", F.inline("__tags")).select(*key, "dimension", "value", "confidence", "evidence")
