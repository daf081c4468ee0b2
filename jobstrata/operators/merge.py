"""Keyed upserts with a rule for each column, and the rebuilds around them, as full outer joins and anti joins.

Rules: `new` (the incoming value wins, even if null), `coalesce` (the incoming value unless it is null), `keep` (the stored value once
there is a row), `first`/`last` (the smaller or larger of both, nulls aside), or a function of the stored and the incoming column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = str | Callable[[Column, Column], Column]


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order given, which ends in something unique."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], rules: Mapping[str, Rule]) -> DataFrame:
    """The stored table after the incoming rows (one a key). Columns are those of key and rules."""
    a = stored.select(*[F.col(k) for k in key], F.struct(*rules).alias("__old"))
    b = incoming.select(*[F.col(k) for k in key], F.struct(*rules).alias("__new"))
    both = a.join(b, key, "full")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(name: str, rule: Rule) -> Column:
        old, new = F.col(f"__old.{name}"), F.col(f"__new.{name}")
        if callable(rule):
            merged = rule(old, new)
        else:
            merged = {"new": new, "coalesce": F.coalesce(new, old), "keep": old, "first": F.least(old, new), "last": F.greatest(old, new)}[rule]
        return F.when(has_old & has_new, merged).when(has_new, new).otherwise(old).alias(name)

    return both.select(*key, *[value(n, r) for n, r in rules.items()])


def changed(stored: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys of incoming rows that change a column of a stored row, nulls compared as values."""
    a = stored.select(*key, *[F.col(c).alias(f"__o_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return incoming.join(a, key).where(differs).select(*key)


def invalidated(derived: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Derived rows whose evidence hasn't changed."""
    return derived.join(keys, key, "left_anti")


def rebuilt(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows and those stored rows whose key they don't replace."""
    return incoming.unionByName(stored.join(incoming.select(*key).distinct(), key, "left_anti"))


def snapshot(stored: DataFrame, seen: DataFrame, key: list[str], at: Column) -> DataFrame:
    """stored (key, removed_at) after a complete read `seen`: what is absent is withdrawn at `at`, what is back is revived."""
    flag = seen.select(*key).distinct().withColumn("__seen", F.lit(True))
    back = F.when(F.col("__seen"), F.lit(None)).otherwise(F.coalesce("removed_at", at))
    return stored.join(flag, key, "left").withColumn("removed_at", back).drop("__seen")
