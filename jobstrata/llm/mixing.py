"""Mixing sources to target weights by entropy balancing.

Each source has a target of tokens (here words). Of all rates r of documents that meet sum(r * size) = target, at most `most` each, those
are taken that depart least from one copy each in relative entropy: r = min(most, exp(lambda * size / mean size)), an exponential tilt with
one multiplier a source. The multipliers solve the convex dual; its gradient is the tokens that the rates give less the target, its Hessian
is diagonal as each document has one source. Newton's steps, on the logarithm of the tokens and kept within a bracket that each step
narrows, are sums over a table of (source, size, documents) that Spark aggregates: all sources at once, no document is read again.

Rates become copies by cell (source, size), as documents of a cell have one rate: from the longest size to the shortest a source's cells
take whole copies, each of them the nearest number to its share and what the longer ones left over, so that what is left over at the end is
about half of the shortest document, or what the few shorter ones of a small source can't take. The copies of a cell go to its documents by the order of a hash of their keys.

Sums are of whole numbers and the scan is in a fixed order, so reruns agree. A source has fewer cells than the root of twice its tokens;
there is one row a source in the table of targets. A hot source or cell is many tasks' work. Nulls: a null text has size 0; a null source
is a source, the last. Documents without tokens are never taken. Repeated rows are documents each, which share the copies of their cell;
ties in key and size are ordered at random, as such rows are alike. An empty table gives an empty plan. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, numbered, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: rates are summed as whole numbers of this part of one.
UNIT = 10**9
NEAR, ROUNDS = 1e-7, 60
SEED = 13


def n_words(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE.replace("[", "[^", 1))).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with their targets: the total times share by weight, weights repeating in the order of sources by code
    point (null last), at most `most` times a source's size; the excess is shared anew by weight until none is above.

    Where that ends, every source below its most has the same tokens for a weight: the level. It is the first, in the order of the level
    that each source can bear, that the sources up from there can bear with all the tokens that those before leave.
    """
    if sum(weights) <= 0 or min(weights) < 0:
        raise ValueError("weights can't be negative and not all zero")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights)))
    own = weighed.withColumns({"most": most * F.col("source_size"), "bears": F.when(F.col("weight") > 0, most * F.col("source_size") / F.col("weight")).otherwise(float("inf"))})
    by = Window.orderBy("bears", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(rest > 0, (share * F.sum("source_size").over(Window.partitionBy()) - before) / rest)
    leveled = own.withColumn("level", level)
    leveled = leveled.withColumn("turn", F.row_number().over(by))
    first = F.min(F.when(F.col("level") <= F.col("bears"), F.struct("turn", "level"))).over(Window.partitionBy())["level"]
    return leveled.withColumn("level", first).select("source", "source_size", F.when(F.col("weight") > 0, F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).otherwise(0.0).alias("target"))


def rate(most: float) -> Column:
    """The rate of a cell under its source's multiplier."""
    tilted = F.least(F.lit(most), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(1.0 + most))))
    return F.when(F.col("target") <= 0, 0.0).when(F.col("full"), most).otherwise(tilted)


def balanced(cells: DataFrame, aims: DataFrame, most: float = MOST, near: float = NEAR, rounds: int = ROUNDS) -> DataFrame:
    """The multiplier of each source (source, source_size, target, mean, full, multiplier), by Newton's steps over cells (source, size, n)."""
    shape = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    ratio, least = F.col("target") / F.col("source_size"), F.col("least") / F.col("mean")
    start = _with(aims, shape).select("source", "source_size", "target", "mean", (ratio >= most * (1 - 1e-12)).alias("full"), F.when(ratio > 1, 0.0).otherwise(F.log(ratio) / least).alias("low"), F.when(ratio > 1, F.log(F.lit(most)) / least).otherwise(0.0).alias("high"), F.log(ratio).alias("multiplier"))
    # nothing is to solve where all is taken `most` times or nothing at all
    state = stored(start.withColumn("off", F.lit(None).cast("double")), "multipliers")
    r, z = rate(most), F.col("size") / F.col("mean")
    whole = lambda c: F.sum((F.col("n") * F.col("size")).cast("decimal(20,0)") * F.round(c * UNIT).cast("decimal(18,0)"))
    for _ in range(rounds):
        sums = _with(cells, state).groupBy("source").agg(whole(r).cast("double").alias("f"), whole(F.when(r < most, r * F.least(z, F.lit(1e6))).otherwise(0.0)).cast("double").alias("d"))
        aim = F.col("target") * UNIT
        step = F.col("multiplier") - (F.log("f") - F.log(aim)) * F.col("f") / F.nullif(F.col("d"), F.lit(0.0))
        low, high = F.when(F.col("f") < aim, F.col("multiplier")).otherwise(F.col("low")), F.when(F.col("f") < aim, F.col("high")).otherwise(F.col("multiplier"))
        open_ = (F.col("target") > 0) & ~F.col("full")
        off = F.when(open_, F.abs(F.col("f") / aim - 1)).otherwise(0.0)
        stepped = _with(state.drop("off"), sums).withColumns({"off": off, "low": low, "high": high, "step": step})
        inside = (F.col("d") > 0) & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        moved = F.when(F.col("off") <= near, F.col("multiplier")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(stepped.withColumn("multiplier", moved).select(*state.columns), "multipliers")
        if not (state.agg(F.max("off")).first()[0] or 0.0) > near:
            break
    return state


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source's row."""
    own = sources.withColumnRenamed("source", "__source")
    return rows.join(own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def rounded(cells: DataFrame, state: DataFrame, most: float = MOST) -> DataFrame:
    """cells with copies: of all documents of a cell together. What a cell leaves over goes on to the next shorter one of its source."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for source, own in groupby(rows, key=lambda r: r["source"]):
            left, out = 0.0, []
            for r in own:
                want = left + r["n"] * r["rate"] * r["size"]
                copies = max(0, min(int(most * r["n"]), round(want / r["size"])))
                left = want - copies * r["size"]
                out.append((source, r["size"], copies))
                if len(out) == 4096:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["source", "size", "copies"])

    rated = _with(cells, state).select("source", "size", "n", rate(most).alias("rate"))
    return rated.repartition("source").sortWithinPartitions("source", F.desc("size")).mapInArrow(scan, "source string, size long, copies long")


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = 2, group: str = "source", key: str = "doc_id", size: Column | None = None, whole: bool = False) -> DataFrame:
    """Of each document: key, source, size, source_size, target, copies, and taken = copies * size; its whole row too if asked for."""
    if not 0 <= share <= most:
        raise ValueError("no document is taken more than `most` times, so no more than that can be shared out")
    rows = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("source"), (n_words(F.col("text")) if size is None else size.cast("long")).alias("size"), *([F.struct("*").alias("row")] if whole else []))
    rows = stored(rows.withColumn("spread", F.xxhash64(F.lit(SEED), "key")), "sizes")
    every = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    aims = stored(targets(every.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "targets")
    cells = every.where("size > 0")
    state = balanced(cells, aims.where("source_size > 0"), most)
    taken = rounded(cells, state, most).select(F.col("source").alias("__s"), F.col("size").alias("__z"), "copies")
    found = every.join(taken, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left").drop("__s", "__z")
    about = _with(found, aims).select("source", "size", F.coalesce("copies", F.lit(0)).alias("in_cell"), "source_size", "target")
    placed = numbered(rows, ["source", "size"], ["spread", "key"], "placed", stored(about, "about"))
    copies = F.expr("in_cell div n_group") + F.when(F.col("position") < F.col("in_cell") % F.col("n_group"), 1).otherwise(0)
    return placed.withColumn("copies", copies).select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if whole else []))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns and the number of the copy (from 1)."""
    plan = planned(docs, whole=True, **options).where("copies > 0")
    return plan.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_number"))


def digest(plan: DataFrame) -> DataFrame:
    """What the query returns."""
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
