"""Entity resolution: rows that share an identity key, directly or through others, are one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of a graph of edges (a, b), by large-star and small-star rounds. Null edges are dropped.

    Each round is written to the shared folder; one count and two checksums come to the driver. The smallest neighbours are written,
    too, so that their join is one of two plain exchanges, which Spark splits where a node has very many neighbours.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (mark := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()) != before and mark[0]:
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ambiguous(keys: DataFrame, kind: str, by: str, most: int) -> DataFrame:
    """Keys of a kind that more than `most` distinct values of `by` share: they identify nobody."""
    return keys.where(F.col("kind") == kind).groupBy("key").agg(F.count_distinct(by).alias("n")).where(F.col("n") > most).select("key")


def resolved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """id, component and entity of each row. rows: id; keys: id, kind_rank, key (no nulls).

    The entity's name is its strongest key: smallest rank, then smallest key; of a row without keys, its id.
    Rows and keys are a bipartite graph: a hot key is a star, never a list of pairs.
    """
    named = keys.withColumn("__k", F.concat_ws(":", F.lit("k"), F.col("kind_rank").cast("string"), "key"))
    parts = components(named.select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("a"), F.col("__k").alias("b")).distinct())
    whole = rows.select("id").join(parts.select(F.col("node"), "component"), F.concat(F.lit("r:"), F.col("id").cast("string")) == F.col("node"), "left").select("id", F.coalesce("component", F.concat(F.lit("r:"), F.col("id").cast("string"))).alias("component"))
    best = whole.join(keys, "id").groupBy("component").agg(F.min(F.struct("kind_rank", "key")).alias("s")).select("component", F.col("s.key").alias("entity"))
    return whole.join(best, "component", "left").select("id", "component", F.coalesce("entity", F.col("id").cast("string")).alias("entity"))


def commonest(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The commonest non-empty value of each group; of ties the shortest, then the smallest."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.length(value), value)
    return counts.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
