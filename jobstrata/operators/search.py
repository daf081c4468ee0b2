"""Faceted search over long-format tags, gates, and profiles of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def faceted(rows: DataFrame, tags: DataFrame, key: list[str], require: Mapping[str, Sequence[str]], exclude: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """rows with, for every required dimension, one of its values, and with none of the excluded ones."""
    for dimension, values in require.items():
        rows = rows.join(tags.where((F.col("dimension") == dimension) & F.col("value").isin(*values)).select(*key), key, "left_semi")
    for dimension, values in (exclude or {}).items():
        rows = rows.join(tags.where((F.col("dimension") == dimension) & F.col("value").isin(*values)).select(*key), key, "left_anti")
    return rows


def _one_of(dimension: str, values: Sequence[str]):
    return lambda t: (t["dimension"] == dimension) & t["value"].isin(*values)


def facets(tags: str, require: Mapping[str, Sequence[str]], exclude: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The same test on a column of tags: rows that keep their tags in a list need no join."""
    out = F.lit(True)
    for dimension, values in require.items():
        out = out & F.exists(tags, _one_of(dimension, values))
    for dimension, values in (exclude or {}).items():
        out = out & ~F.exists(tags, _one_of(dimension, values))
    return out


def wide_columns(tags: str, single: Sequence[str], multiple: Sequence[str]) -> list[Column]:
    """As `wide`, from a column of tags."""
    of = lambda d: F.transform(F.filter(tags, lambda t: (t["dimension"] == d) & (t["value"] != "unknown")), lambda t: t["value"])
    return [*[F.array_max(of(d)).alias(d) for d in single], *[F.array_sort(F.array_distinct(of(d))).alias(d) for d in multiple]]


def ranked(value: Column, order: Sequence[str]) -> Column:
    """The place of a value in an order; what isn't in it comes last."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(value == v, k).otherwise(out)
    return out


def wide(tags: DataFrame, key: list[str], single: Sequence[str], multiple: Sequence[str]) -> DataFrame:
    """One row a key: single-valued dimensions as columns, others as sorted lists; `unknown` is left out."""
    of = lambda d: F.when((F.col("dimension") == d) & (F.col("value") != "unknown"), F.col("value"))
    return tags.groupBy(*key).agg(*[F.max(of(d)).alias(d) for d in single], *[F.array_sort(F.collect_set(of(d))).alias(d) for d in multiple])


def gated(rows: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with `gate`: the first in order whose condition holds, null if none does. Nothing is filtered, so counts add up."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(gates):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return rows.withColumn("gate", out)


def gate_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("gate", F.lit("kept")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def profile(rows: DataFrame, group: list[str], verdict: str, least: int, floor: float) -> DataFrame:
    """Of each group n, hits, undecided and share: kept rows, and undecided ones for a quarter, over all; `keep` needs least rows and the floor."""
    kept, open_ = F.count_if(F.col(verdict) == "keep"), F.count_if(F.col(verdict) == "undecided")
    own = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), kept.alias("hits"), open_.alias("undecided"))
    share = (F.col("hits") + F.col("undecided") / 4) / F.col("n")
    return own.withColumn("share", share).withColumn("keep", (F.col("n") >= least) & (F.col("share") >= floor))


def chosen_domain(rows: DataFrame, board: list[str]) -> DataFrame:
    """The domain that most rows of a board have; of ties the largest name."""
    counts = rows.where("domain IS NOT NULL").groupBy(*board, "domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*board).agg(F.max(F.struct("n", "domain")).alias("m")).select(*board, "m.domain", "m.n")
