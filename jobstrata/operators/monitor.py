"""Run histories, failure streaks, changes of snapshots, estimates of coverage, agreement with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alerts(runs: DataFrame, source: str = "source", least: int = 2, floor: float = 0.7, deltas: tuple[str, ...] = ()) -> DataFrame:
    """source, kind, latest and baseline of sources whose latest run (by started_at, id) failed, was empty or shrank.

    The baseline is the median row_count of earlier successful runs that had rows; shrank means below `floor` of it, with
    `least` such runs; sources in `deltas` never shrink or are empty.
    """
    order = Window.partitionBy(source).orderBy(F.desc("started_at"), F.desc("id"))
    ranked = runs.withColumn("__rn", F.row_number().over(order))
    past = (F.col("__rn") > 1) & F.col("ok") & (F.col("row_count") > 0)
    one = ranked.groupBy(source).agg(
        F.max(F.when(F.col("__rn") == 1, F.col("row_count"))).alias("latest"),
        F.bool_and(F.when(F.col("__rn") == 1, F.col("ok"))).alias("ok"),
        F.median(F.when(past, F.col("row_count"))).alias("baseline"),
        F.count_if(past).alias("history"),
    )
    whole = ~F.col(source).isin(*deltas) if deltas else F.lit(True)
    kind = F.when(~F.col("ok"), "fail").when(whole & (F.col("latest") == 0), "empty").when(whole & (F.col("history") >= least) & (F.col("latest") < floor * F.col("baseline")), "shrank")
    return one.withColumn("kind", kind).where("kind IS NOT NULL").select(source, "kind", "latest", "baseline")


def streaks(polls: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """polls with failures: consecutive failures up to each poll; a success sets it to 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = polls.withColumn("__run", run)
    inside = Window.partitionBy(*key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures", F.sum((~F.col("ok")).cast("long")).over(inside)).drop("__run")


def health(polls: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The state of each key after its polls: failures, postings and last_ok survive a failure."""
    latest = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now = streaks(polls, key, order)
    state = now.select(*key, F.last("failures").over(latest).alias("failures"), F.last(F.when(F.col("ok"), F.col("postings")), ignorenulls=True).over(latest).alias("postings"), F.last(F.when(F.col("ok"), F.col("polled_at")), ignorenulls=True).over(latest).alias("last_ok"))
    return state.distinct()


def changes(shots: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Snapshots with changed (differs from the one before; the first doesn't) and changes so far."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    out = shots.withColumn("changed", ~first & ~F.col(value).eqNullSafe(before))
    return out.withColumn("changes", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: n_first, n_second and both, distinct keys; nulls don't count."""
    a = first.where(F.col(key).isNotNull()).select(key).distinct().withColumn("a", F.lit(1))
    b = second.where(F.col(key).isNotNull()).select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").agg(F.count("a").alias("n_first"), F.count("b").alias("n_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def agreement(labelled: DataFrame, truth: str, said: str, by: list[str]) -> DataFrame:
    """n, silent (nothing said), agreed and rate (of those with something said, null if there are none) for each group."""
    own = labelled.where(F.col(truth).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(said).isNull()).alias("silent"), F.count_if(F.col(truth) == F.col(said)).alias("agreed"))
    return own.withColumn("rate", F.try_divide(F.col("agreed"), F.col("n") - F.col("silent")))


def shortfall(advertised: Column, read: Column, served: Column | None = None, share: float = 0.02) -> Column:
    """Whether a walk read too little of what was advertised: more than one row and `share` are missing; rows served twice aren't."""
    got = F.greatest(read, served) if served is not None else read
    return F.coalesce(advertised - got > F.greatest(F.lit(1.0), F.lit(share) * advertised), F.lit(False))
