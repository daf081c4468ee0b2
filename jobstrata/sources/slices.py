"""Reading a board through a window: slices that are split until they fit, both ends of a sequence, pages in order - with a proof of what was read.

A board answers a query with its number of hits and serves the first `window` rows of it only. What a captured board holds is a table;
these operators say which of its rows a walk reaches, by which query, and whether that is all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import numbered, stored


@dataclass
class Walk:
    """leaves: slice (array of `dimension=value`), hits, n_read, truncated. reached: key and slice of each row of each leaf that was read.
    unsplit: key and slice of rows that a split lost, as they have no value in the dimension that it splits by."""

    leaves: DataFrame
    reached: DataFrame
    unsplit: DataFrame


def walked(rows: DataFrame, key: str, dims: list[str], window: int, order: list[Column]) -> Walk:
    """FED-03: the slices of a board's rows. The frontier starts with the values of the first dimension; a slice with more hits than the window
    is split by the next one, until it fits or no dimension is left; then its first rows by order are read, and it is truncated.

    Dimensions are columns of strings, or of arrays of them: a row is in the slice of each of its values. Only rows of slices that don't
    fit go on to the next dimension, so each level is one aggregation and one join of less; a slice is never collected, and of a
    truncated one each task keeps `window` rows before they are shuffled. Nulls and empty arrays are in no slice of that dimension.
    Rows with one key are one row, the first by order. An empty table gives no leaf.
    """
    kinds = dict(rows.dtypes)
    spread = lambda d: F.array_distinct(F.filter(F.col(d) if kinds[d].startswith("array") else F.array(d), lambda x: x.isNotNull()))
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    once = rows.select(key, *dims, rank.alias("__rank")).groupBy(key).agg(F.min_by(F.struct(*dims), "__rank").alias("d"), F.min("__rank").alias("__rank"))
    front = stored(once.select(key, "__rank", *[F.col(f"d.{d}").alias(d) for d in dims], F.array().cast("array<string>").alias("slice")), "front")
    leaves, reached, lost = [], [], []
    for k, dim in enumerate(dims):
        lost.append(front.where(F.coalesce(F.size(spread(dim)), F.lit(0)) == 0).select(key, "slice"))
        cut = front.withColumn("__v", F.explode(spread(dim))).withColumn("slice", F.concat("slice", F.array(F.concat(F.lit(f"{dim}="), "__v")))).drop("__v", dim)
        cut = stored(cut, "slices")
        hits = stored(cut.groupBy("slice").agg(F.count(F.lit(1)).alias("hits")), "hits")
        last = k + 1 == len(dims)
        ends = hits if last else hits.where(F.col("hits") <= window)
        leaves.append(ends)
        within = cut.join(ends.select("slice"), "slice", "left_semi")
        if last:  # what fits is read whole, so only here a limit is needed
            own = Window.partitionBy("slice").orderBy("__rank", key)
            within = within.withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= window)
        reached.append(within.select(key, "slice"))
        if not last:
            front = cut.join(hits.where(F.col("hits") > window).select("slice"), "slice", "left_semi")
    ends = _united(leaves)
    read = F.least("hits", F.lit(window).cast("long"))
    return Walk(ends.select("slice", "hits", read.alias("n_read"), (F.col("hits") > window).alias("truncated")), _united(reached), _united(lost))


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def labelled(walk: Walk, key: str) -> DataFrame:
    """FED-03: each row that was reached, once, with the values of the first dimension under which it was (labels, sorted), and how many leaves served it."""
    label = F.expr("substr(slice[0], instr(slice[0], '=') + 1)")
    return walk.reached.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count(F.lit(1)).alias("n_leaves"))


def proof(walk: Walk, rows: DataFrame, key: str, advertised: Column | None = None) -> DataFrame:
    """FED-02, 03, 06: one row: what the board advertises (distinct keys, or the column's largest value), what was seen, truncated leaves and the
    rows that these kept back at least, rows that no split could place and that no leaf reached, and whether the walk is complete."""
    said = rows.agg((F.count_distinct(key) if advertised is None else F.max(advertised)).alias("advertised"))
    seen = walk.reached.select(key).distinct()
    told = walk.leaves.agg(F.count(F.lit(1)).alias("n_leaves"), F.count_if("truncated").alias("n_truncated"), F.coalesce(F.sum(F.col("hits") - F.col("n_read")), F.lit(0)).alias("n_kept_back"))
    n_lost = walk.unsplit.select(key).distinct().join(seen, key, "left_anti").agg(F.count(F.lit(1)).alias("n_unsplit"))
    one = said.join(F.broadcast(seen.agg(F.count(F.lit(1)).alias("seen")))).join(F.broadcast(told)).join(F.broadcast(n_lost))  # a row each
    return one.withColumn("complete", F.col("seen") >= F.col("advertised"))


def shares(reads: DataFrame, key: str, part: str, advertised: DataFrame) -> DataFrame:
    """FED-06: the check of a partition: of each part what it advertises (part, advertised) and what was got, how many of its keys other parts have
    too (none, if it is a partition), and sound. A part that was never read got nothing; one that isn't advertised is unsound."""
    own = reads.select(key, part).distinct()
    several = own.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    got = own.join(several, key).groupBy(part).agg(F.count(F.lit(1)).alias("got"), F.count_if(F.col("__n") > 1).alias("shared"))
    both = advertised.select(part, "advertised").join(got, part, "full")
    both = both.select(part, "advertised", F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("shared", F.lit(0)).alias("shared"))
    return both.withColumn("sound", F.coalesce((F.col("got") == F.col("advertised")) & (F.col("shared") == 0), F.lit(False)))


def two_ended(rows: DataFrame, key: str, age: str, order: list[str], reach: int, days: int) -> DataFrame:
    """FED-02: the rows of the last `days` days that a board serves from both ends, each with the window (in days) that reached it first.

    A window of d days holds the rows with age < d, sorted by `order`, youngest first; its first `reach` and last `reach` rows can be read.
    If that leaves rows in the middle, the window is made a day shorter, again and again, until as many keys were seen as the first
    window holds, or no day is left. Columns: key, age, place (in the first window, from 0), reached_by (null if never), and sound,
    which is the same for all: only then a cursor may move. Rows older than that are no part of it; a null age is none of any window.

    Places are dealt out by range over all tasks. Of each window only its number of rows is needed, which is an array of `days` numbers.
    """
    own = rows.where((F.col(age) < days) & (F.col(age) >= 0)).select(key, age, *[c for c in order if c not in (key, age)]).withColumn("__all", F.lit(0))
    placed = numbered(own, ["__all"], [age, *[c for c in order if c != age], key], "sequence")
    per_day = placed.groupBy(age).agg(F.count(F.lit(1)).alias("n"))
    held = per_day.agg(*[F.coalesce(F.sum(F.when(F.col(age) < d, F.col("n"))), F.lit(0)).alias(f"n{d}") for d in range(1, days + 1)])
    sizes = held.select(F.array(*[f"n{d}" for d in range(1, days + 1)]).alias("__sizes"))
    tail = lambda n, d: (n - F.col("position") <= reach) & (d + 1 > F.col(age))
    found = F.array_max(F.filter(F.transform("__sizes", lambda n, d: F.when(tail(n, d), d + 1)), lambda d: d.isNotNull()))
    first = placed.join(F.broadcast(sizes)).withColumn("__by", F.when(F.col("position") < reach, F.lit(days)).otherwise(found).cast("int"))
    first = stored(first.select(key, age, F.col("position").alias("place"), "__by"), "ends")
    counts = first.where("__by IS NOT NULL").groupBy("__by").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(first.agg(F.count(F.lit(1)).alias("__all")))
    upto = counts.withColumn("__seen", F.sum("n").over(Window.orderBy(F.desc("__by"))))  # a row a day
    ended = upto.join(total).agg(F.max(F.when(F.col("__seen") >= F.col("__all"), F.col("__by"))).alias("__stop"))
    last = F.broadcast(ended.select(F.coalesce("__stop", F.lit(1)).alias("__last"), F.col("__stop").isNotNull().alias("sound")))
    return first.join(last).select(key, age, "place", F.when(F.col("__by") >= F.col("__last"), F.col("__by")).alias("reached_by"), "sound")


#: how a walk over pages may end.
EMPTY, REPEATED, THROTTLED, FAILED, OPEN = "empty", "repeated", "throttled", "failed", "open"


def sequences(pages: DataFrame, walk: str, page: str = "page", status: str = "status", ids: str = "ids") -> DataFrame:
    """FED-04, FED-05: walks over one unfiltered sequence of pages (walk, page, status, ids): n_pages read, n_rows (distinct ids), ended, complete.

    A walk ends at its first page that is empty (`empty`: the only complete end), has the ids of one before it (`repeated`: the board went
    round, so nothing after it can be trusted), was refused for haste (`throttled`, status 429) or failed (any other status but 200, or a
    page number left out); without any of these it is `open`. Rows of pages before the end stay. A page captured twice counts
    once, the last by status and ids. A null list is a failed page.
    """
    stop, before = _stops(pages, walk, page, status, ids)
    kept = before.groupBy(walk).agg(F.count_distinct(page).alias("n_pages"), F.count_distinct("id").alias("n_rows"))
    out = stop.join(kept, walk, "left").select(walk, F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "ended")
    return out.withColumn("complete", F.col("ended") == EMPTY)


def sequence_rows(pages: DataFrame, walk: str, page: str = "page", status: str = "status", ids: str = "ids") -> DataFrame:
    """FED-04, FED-05: walk and id of the rows that such walks read, each once: those of the pages before the end."""
    return _stops(pages, walk, page, status, ids)[1].select(walk, "id").distinct()


def _stops(pages: DataFrame, walk: str, page: str, status: str, ids: str) -> tuple[DataFrame, DataFrame]:
    one = pages.groupBy(walk, page).agg(F.max(F.struct(F.col(status).alias("s"), F.col(ids).alias("i"))).alias("p")).select(walk, page, "p.s", "p.i")
    one = stored(one.withColumn("digest", F.sha2(F.to_json(F.struct("i")), 256)), "pages")
    same = Window.partitionBy(walk, "digest").orderBy(page)
    order = Window.partitionBy(walk).orderBy(page)
    gap = F.col(page) != F.coalesce(F.lag(page).over(order) + 1, F.lit(1))
    why = (
        F.when(gap, FAILED).when(F.col("s") == 429, THROTTLED).when((F.coalesce("s", F.lit(0)) != 200) | F.col("i").isNull(), FAILED)
        .when(F.size("i") == 0, EMPTY).when(F.row_number().over(same) > 1, REPEATED)
    )
    told = one.select(walk, page, why.alias("why"))
    ends = told.groupBy(walk).agg(F.min(F.when(F.col("why").isNotNull(), F.struct(page, "why"))).alias("e"), F.max(page).alias("__last"))
    ends = ends.select(walk, F.coalesce(F.col("e.why"), F.lit(OPEN)).alias("ended"), F.coalesce(F.col(f"e.{page}"), F.col("__last") + 1).alias("__end"))
    before = one.join(ends.select(walk, "__end"), walk).where(F.col(page) < F.col("__end")).select(walk, page, F.explode("i").alias("id"))
    return ends.select(walk, "ended"), before


def two_hops(sites: DataFrame, pages: DataFrame, budget: int = 6) -> DataFrame:
    """SRC-14: tier, url, vendor, why and n_fetched of each site (site, home), from captured pages (url, readable, links in order, vendor).

    A: the home page, or one of the pages that it links to, or that those link to, is a known vendor's; B: none is, but one of them is
    readable; C: none is readable, or there is no link. After the home page at most `budget` pages a site are read, unreadable ones
    included: those that it links to first, in order, then what those link to, each once; reading ends with the first vendor's page.
    A page that wasn't captured is unreadable; of pages captured twice a readable one with a vendor wins. Null links are none.

    The frontier meets the pages by two equi-joins, of a site `budget` rows at most each; what a site's pages link to is ranked where it
    is a few rows times the links of a page.
    """
    told = pages.groupBy("url").agg(F.max(F.struct(F.coalesce("readable", F.lit(False)).alias("readable"), F.col("vendor"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))).alias("p")).select("url", "p.*")
    told = told.select("url", "readable", F.when(F.col("readable"), F.col("vendor")).alias("vendor"), F.when(F.col("readable"), F.array_distinct(F.filter("links", lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>")).alias("links"))
    home = stored(sites.select("site", F.col("home").alias("url")).dropDuplicates(["site"]).join(told, "url", "left").withColumn("readable", F.coalesce("readable", F.lit(False))), "homes")
    go = home.where(F.col("readable") & F.col("vendor").isNull())
    first = go.select("site", F.posexplode("links").alias("at", "url")).where(F.col("at") < budget)
    first = stored(first.join(told, "url", "left").select("site", "url", F.col("at").alias("turn"), F.coalesce("readable", F.lit(False)).alias("readable"), "vendor", "links"), "hop")
    # a site whose vendor was found reads nothing more; what is read on has room left by its first pages
    state = first.groupBy("site").agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("vendor").isNotNull()).alias("__hit"))
    deeper = first.join(state.where(~F.col("__hit") & (F.col("__n") < budget)), "site").where("readable").select("site", "__n", "turn", F.posexplode("links").alias("at", "url"))
    once = deeper.groupBy("site", "__n", "url").agg(F.min(F.struct("turn", "at")).alias("o")).join(first.select("site", "url"), ["site", "url"], "left_anti")
    ranked = once.withColumn("__r", F.row_number().over(Window.partitionBy("site").orderBy("o", "url"))).where(F.col("__r") + F.col("__n") <= budget)
    second = ranked.join(told, "url", "left").select("site", "url", (F.col("__n") + F.col("__r") - 1).alias("turn"), F.coalesce("readable", F.lit(False)).alias("readable"), "vendor")
    read = first.drop("links").unionByName(second).groupBy("site").agg(F.min(F.when(F.col("vendor").isNotNull(), F.struct("turn", "url", "vendor"))).alias("hit"), F.min(F.when(F.col("readable"), F.struct("turn", "url"))).alias("ok"), F.count(F.lit(1)).alias("n"))
    both = home.select("site", F.col("url").alias("home"), "readable", F.col("vendor").alias("own"), (F.size(F.coalesce("links", F.array().cast("array<string>"))) > 0).alias("linked")).join(read, "site", "left")
    why = F.when(~F.col("readable"), "home unreadable").when(F.col("own").isNotNull(), "vendor on the home page").when(~F.col("linked"), "no link").when(F.col("hit").isNotNull(), "vendor").when(F.col("ok").isNotNull(), "readable page").otherwise("links unreadable")
    tier = F.when(F.col("own").isNotNull() | F.col("hit").isNotNull(), "A").when(F.col("ok").isNotNull(), "B").otherwise("C")
    url = F.when(F.col("own").isNotNull(), F.col("home")).otherwise(F.coalesce("hit.url", "ok.url"))
    return both.select("site", tier.alias("tier"), url.alias("url"), F.coalesce("own", "hit.vendor").alias("vendor"), why.alias("why"), F.coalesce(F.col("hit.turn") + 1, "n", F.lit(0)).cast("long").alias("n_fetched"))
