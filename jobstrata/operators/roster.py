"""Rosters of firms against boards and portals: whose board is read, who has postings today, whom only a portal names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _grams(text: Column, k: int) -> Column:
    return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def spelled(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """JON-13 for names of any length: name and text of each text that contains the name. Both lower-case; empty names are in none.

    A name is looked up by the rarest of its runs of three letters (of its own length, if it is shorter), counted over the names; what comes
    near is checked. Different names and texts only are compared.
    """
    own, all_ = names.select(name).where(F.col(name) != "").distinct(), texts.select(text).where(F.col(text) != "").distinct()
    mine = own.select(name, F.explode(F.array_distinct(F.when(F.length(name) >= 3, _grams(F.col(name), 3)).otherwise(F.array(F.col(name))))).alias("g"))
    often = mine.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    key = mine.join(often, "g").groupBy(name).agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    t = F.col(text)
    theirs = all_.select(text, F.explode(F.array_distinct(F.concat(_grams(t, 1), _grams(t, 2), _grams(t, 3)))).alias("g")).join(key.select("g").distinct(), "g", "left_semi")
    return theirs.join(key, "g").where(F.contains(text, F.col(name))).select(name, text)


def portal_counts(targets: DataFrame, jobs: DataFrame) -> DataFrame:
    """label and portal: open postings on portals of each target (label, domain, names in order of precedence).

    Those under its domain; without any, those whose employer contains its first spelling that any does. jobs: domain, employer, portal, removed.
    """
    open_ = jobs.where(F.col("portal") & ~F.col("removed"))
    by_domain = open_.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count(F.lit(1)).alias("under"))
    employers = stored(open_.where(F.col("employer").isNotNull()).groupBy(F.lower("employer").alias("employer")).agg(F.count(F.lit(1)).alias("n")), "employers")
    named = targets.join(by_domain, "domain", "left").select("label", "under", "names")
    names = stored(named.where(F.col("under").isNull()).select("label", F.posexplode(F.transform("names", lambda x: F.lower(x))).alias("at", "name")), "names")
    hits = spelled(names, employers, "name", "employer").join(employers, "employer").groupBy("name").agg(F.sum("n").alias("n"))
    first = names.join(hits, "name").groupBy("label").agg(F.min(F.struct("at", "n"))["n"].alias("spelled"))
    return named.select("label", "under").join(first, "label", "left").select("label", F.coalesce("under", "spelled", F.lit(0)).alias("portal"))


def own_boards(jobs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """domain, postings (open, on boards that are no portal: under the domain or on the board that it was resolved to, whichever has more) and
    board: whether such a board is known. resolutions: domain, tier, ats, token, portal."""
    open_ = jobs.where(~F.col("removed"))
    under = open_.where(~F.col("portal") & F.col("domain").isNotNull()).groupBy("domain").agg(F.count(F.lit(1)).alias("under"))
    boards = open_.groupBy("ats", "token").agg(F.count(F.lit(1)).alias("n"))
    known = resolutions.where((F.col("tier") == "A") & F.col("token").isNotNull() & ~F.col("portal")).join(boards, ["ats", "token"], "left").groupBy("domain").agg(F.max(F.coalesce("n", F.lit(0))).alias("on_board"), F.lit(True).alias("board"))
    both = under.join(known, "domain", "full")
    return both.select("domain", F.greatest(F.coalesce("under", F.lit(0)), F.coalesce("on_board", F.lit(0))).alias("postings"), F.coalesce("board", F.lit(False)).alias("board"))


def followed(roster: DataFrame, targets: DataFrame, jobs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """ENT-07, ENT-08, JON-12, JON-13: the roster's lines (hub, priority, name, absent) that are expected somewhere, with domain, postings, portal, board,
    polled (its own board has postings), reached (polled, or the board is known) and portal_only (not reached, but a portal names it).

    targets: label (a roster's name), domain, names. A line without a target has none of these; one label has one target.
    """
    counts = portal_counts(targets, jobs)
    about = targets.select("label", "domain").join(counts, "label", "left").join(own_boards(jobs, resolutions), "domain", "left")
    lines = roster.where(~F.col("absent")).select("hub", "priority", "name")
    told = lines.join(about.withColumnRenamed("label", "name"), "name", "left")
    told = told.select("hub", "priority", "name", "domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("postings", "portal")], F.coalesce("board", F.lit(False)).alias("board"))
    polled = F.col("postings") > 0
    reached = polled | F.col("board")
    return told.withColumns({"polled": polled, "reached": reached, "portal_only": ~reached & (F.col("portal") > 0)})


def hub_rates(lines: DataFrame) -> DataFrame:
    """AGG-26: of each priority and hub its lines, how many are reached, producing and seen on a portal only, and the producing ones' postings. A firm
    of four hubs counts in four."""
    return lines.groupBy("priority", "hub").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("reached").alias("reached"), F.count_if("polled").alias("producing"), F.count_if("portal_only").alias("portal_only"),
        F.coalesce(F.sum(F.when(F.col("polled"), F.col("postings"))), F.lit(0)).alias("postings"),
    )


def headline(lines: DataFrame) -> DataFrame:
    """EVL-12: one row: firms, each once however many lines it has, and how many are reached, producing and seen on a portal only."""
    firms = lines.groupBy(F.lower(F.trim("name")).alias("firm")).agg(*[F.max(c).alias(c) for c in ("reached", "polled", "portal_only")])
    return firms.agg(F.count(F.lit(1)).alias("firms"), F.count_if("reached").alias("reached"), F.count_if("polled").alias("producing"), F.count_if(F.col("portal_only") & ~F.col("reached")).alias("portal_only"))


def missing(lines: DataFrame, priority: str) -> DataFrame:
    """EVL-12: the firms of a priority's hubs that no board reaches, each a piece of work, with what portals show of them."""
    return lines.where((F.col("priority") == priority) & ~F.col("reached")).select("hub", "name", "portal", "domain").distinct()
