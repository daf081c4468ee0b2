"""Draws that any rerun repeats: by the digest of the key, in strata, in turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def uniform(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k rows whose keys' digests are smallest."""
    return rows.orderBy(digest(key), *key).limit(k)


def stratified(rows: DataFrame, stratum: str, quotas: dict[str, int], key: list[str], cap_by: str | None = None, cap: int = 2) -> DataFrame:
    """quotas[s] rows of each stratum by digest, of one `cap_by` at most `cap` within a stratum."""
    ranked = rows.withColumn("__d", digest(key))
    if cap_by:
        ranked = ranked.withColumn("__c", F.row_number().over(Window.partitionBy(stratum, cap_by).orderBy("__d", *key))).where(F.col("__c") <= cap).drop("__c")
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__d", *key)))
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(stratum) == name, n).otherwise(quota)
    return ranked.where(F.col("__r") <= quota).drop("__d", "__r")


def interleaved(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with turn and group_rank: sorted by both, groups take turns in the order of their names."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    return rows.withColumn("turn", turn).withColumn("group_rank", F.col(group))


def spread(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """`size` rows of each group, evenly spread over its order, the first and the last among them."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    if size < 2:
        return ranked.where("__i = 0").drop("__i", "__n")
    step = (F.col("__n") - 1) / F.lit(size - 1)
    slot = F.floor(F.col("__i") / step + F.lit(0.5))
    near = (F.col("__n") <= size) | (F.floor(slot * step + F.lit(0.5)) == F.col("__i"))
    return ranked.where(near).drop("__i", "__n")
