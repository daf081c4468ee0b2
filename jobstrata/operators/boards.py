"""Boards and what is on them: whether a posting is still offered, whose a board is, queues, pages of a sorted table, fair draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def still_listed(rows: DataFrame, live: DataFrame, board: list[str], snapshots: Column) -> DataFrame:
    """FLT-08, AGG-10: rows with gone: `retired_board` if the board isn't live, `withdrawn` if its last complete read came after the row's last_seen.

    Only where `snapshots` holds: elsewhere absence from a read says nothing. No age is looked at. Last reads are one row a board, joined
    back; Spark broadcasts them while they are few.
    """
    reads = rows.groupBy(*board).agg(F.max("last_seen").alias("__read"))
    known = live.select(*board).distinct().withColumn("__live", F.lit(True))
    both = rows.join(reads, board, "left").join(known, board, "left")
    gone = F.when(snapshots & F.col("__live").isNull(), "retired_board").when(snapshots & (F.col("last_seen") < F.col("__read")), "withdrawn")
    return both.withColumn("gone", gone).drop("__read", "__live")


def board_domains(rows: DataFrame, board: str, furniture: Sequence[str]) -> DataFrame:
    """AGG-11: board and domain, for boards that rows of two domains or more name: the only domain with a label that is a piece of the
    board's token; else the smallest domain whose label all others' labels start with; else that of most rows, of ties the largest name."""
    counts = rows.where(F.col("domain").isNotNull() & F.col(board).isNotNull()).groupBy(board, "domain").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split(F.lower("domain"), "[.]")
    label = F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(F.lower("domain"))
    pieces = F.filter(F.split(F.lower(board), "[|_-]+"), lambda p: (p != "") & ~p.isin(*furniture))
    each = counts.select(board, "domain", "n", label.alias("label"), F.arrays_overlap(pieces, labels).alias("named"))
    one = each.groupBy(board).agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if("named").alias("n_named"),
        F.max(F.when(F.col("named"), F.col("domain"))).alias("token"),
        F.min(F.struct(F.length("label").alias("l"), "label", "domain")).alias("short"),
        F.collect_set("label").alias("all"),
        F.max(F.struct("n", "domain")).alias("most"),
    )
    parent = F.when(F.forall("all", lambda x: F.startswith(x, F.col("short.label"))), F.col("short.domain"))
    return one.where("k > 1").select(board, F.when(F.col("n_named") == 1, F.col("token")).otherwise(F.coalesce(parent, F.col("most.domain"))).alias("domain"))


def pages_after(rows: DataFrame, key: list[str], last: Sequence | None, size: int) -> DataFrame:
    """SRT-08: the next `size` rows after the key `last` in the key's order: a comparison of rows that reaches the scan, never an offset."""
    if last is not None:
        after = F.lit(False)
        for k in reversed(range(len(key))):
            after = (F.col(key[k]) > F.lit(last[k])) | ((F.col(key[k]) == F.lit(last[k])) & after)
        rows = rows.where((F.col(key[0]) >= F.lit(last[0])) & after)
    return rows.orderBy(*key).limit(size)


def fair_draw(rows: DataFrame, bucket: str, board: list[str], order: list[Column], shares: Mapping[str, float], limit: int, cap: int = 2) -> DataFrame:
    """SRT-10, WIN-05: `limit` rows in strata: of each bucket its share, of one board `cap` rows at most over all buckets; what a bucket can't fill
    goes to whatever rows are left, earlier buckets first. Fewer only if no further row fits under the cap.

    Rounds of window ranks: in each, candidates of boards with room are ranked by bucket and order within their board, those within its room by
    order within their bucket, and those within the bucket's open quota are taken; a round in which nothing fits ends the quotas, and
    then the whole rest is one quota. Each round takes at least one row if any fits. Ranks that matter are small, so tasks cut
    candidates before they are shuffled. The numbers of a round come to the driver, rows never do. `order` must tell rows apart.
    """
    place = F.array_position(F.array(*[F.lit(b) for b in shares]), F.col(bucket)).cast("int")
    by = [F.col(f"__o{i}") for i in range(len(order))]
    first = Window.partitionBy("__place", *board).orderBy(*by)
    open_ = rows.where(F.col(bucket).isin(*shares)).select("*", place.alias("__place"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    open_ = stored(open_.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= cap).drop("__r"), "candidates")
    taken = open_.limit(0)
    quotas: dict[int, int] | None = {k + 1: round(limit * share) for k, share in enumerate(shares.values())}
    n = 0
    while n < limit:
        used = taken.groupBy(*board).agg(F.count(F.lit(1)).alias("__used")).select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(board)], "__used")
        room = reduce(and_, [F.col(b).eqNullSafe(F.col(f"__b{i}")) for i, b in enumerate(board)])
        left = open_.join(taken.select(*[c.alias(f"__k{i}") for i, c in enumerate(by)]), reduce(and_, [c.eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]), "left_anti")
        left = left.join(used, room, "left").withColumn("__room", cap - F.coalesce("__used", F.lit(0))).drop("__used", *[f"__b{i}" for i in range(len(board))])
        if quotas is not None:  # buckets that have their share don't stand in the way of others
            left = left.where(F.col("__place").isin(*[k for k, q in quotas.items() if q > 0]))
        fits = left.withColumn("__r", F.row_number().over(Window.partitionBy(*board).orderBy("__place", *by))).where(F.col("__r") <= F.col("__room"))
        if quotas is None:
            some = fits.orderBy("__place", *by).limit(limit - n)
        else:
            quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col("__place"))
            some = fits.withColumn("__r", F.row_number().over(Window.partitionBy("__place").orderBy(*by))).where(F.col("__r") <= F.least(quota, F.lit(limit - n)))
            some = some.orderBy("__place", *by).limit(limit - n)
        some = stored(some.select(*open_.columns), "taken")
        got = {r["__place"]: r["n"] for r in some.groupBy("__place").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a bucket
        n += sum(got.values())
        taken = stored(taken.unionByName(some), "drawn")
        if quotas is not None:
            quotas = {k: q - got.get(k, 0) for k, q in quotas.items()} if got else None
        elif not got:
            break
    return taken.select(*rows.columns)


def contained_runs(rows: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """JON-12: rows with each of the names that stands in their text as a run of whole tokens.

    Names are looked up by their rarest token, so a token that many share brings few candidates; each candidate is checked.
    """
    tokens = names.select(name, F.explode(F.array_distinct(F.split(name, " "))).alias("__t"))
    often = tokens.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"))
    key = tokens.join(often, "__t").groupBy(name).agg(F.min(F.struct("__n", "__t")).alias("__k")).select(name, F.col("__k.__t").alias("__t"))
    each = rows.select("*", F.explode(F.array_distinct(F.split(text, " "))).alias("__t"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return each.join(key, "__t").where(F.contains(pad(F.col(text)), pad(F.col(name)))).drop("__t")


def contained_strings(rows: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """JON-13: rows with each of the names that their text contains anywhere; names have three letters at least.

    An equi-join on the name's rarest three letters replaces a comparison of everything with everything; each candidate is checked.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    own = names.where(F.length(name) >= 3).select(name, F.explode(grams(F.col(name))).alias("__g"))
    often = own.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    key = own.join(often, "__g").groupBy(name).agg(F.min(F.struct("__n", "__g")).alias("__k")).select(name, F.col("__k.__g").alias("__g"))
    each = rows.where(F.length(text) >= 3).select("*", F.explode(grams(F.col(text))).alias("__g"))
    return each.join(key, "__g").where(F.contains(text, F.col(name))).drop("__g")


def residual_alerts(own: DataFrame, stale: Column, floor: Column) -> DataFrame:
    """EVL-06: source and kind, one a source at most: what failed first, then what is stale, then what lies below its floor."""
    kind = F.when(~F.col("ok"), "fail").when(stale, "stale").when(floor, "low")
    return own.withColumn("kind", kind).where("kind IS NOT NULL")
