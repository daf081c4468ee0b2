"""Folding duplicates: equal fingerprints, the same advert at two sources, near copies in a block."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import runs
from ..functions.names import LONE_NAME, identity_tokens, same_firm, shared_heads
from . import publish
from .identity import components
from .tables import stored


def collapsed(cards: DataFrame, fingerprint: str, order: list[Column]) -> DataFrame:
    """The first card of each fingerprint with dup, the number of cards folded into it; without a fingerprint nothing folds."""
    key = F.coalesce(F.col(fingerprint), F.concat(F.lit("\x00"), F.col("id").cast("string")))
    w = Window.partitionBy("__key")
    marked = cards.withColumn("__key", key).withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("dup", F.count(F.lit(1)).over(w) - 1)
    return marked.where("__r = 1").drop("__key", "__r")


def classed(cards: DataFrame, alike: list[str | Column], rank: list[Column]) -> DataFrame:
    """The best card (the least by rank) of each class of cards that are equal in all of `alike`, with members, the size of its class.

    A null there equals nothing, and cards of one id are in one class, whatever else they are, so classes that share an id are one. No pairs are
    made: a class is one row from each task. Only of ids that more than one card has it is asked which classes they join.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in alike]
    whole = reduce(and_, [k.isNotNull() for k in (F.col("id"), *keys)])
    own = cards.select(F.struct(*cards.columns).alias("card"), F.struct(*[F.when(whole, k).alias(f"k{i}") for i, k in enumerate(keys)], F.when(~whole, F.col("id")).alias("lone")).alias("class"), F.struct(*rank).alias("rank"))
    best = F.min_by(F.struct("rank", "card"), "rank").alias("best")
    classes = own.groupBy("class").agg(F.min("card.id").alias("component"), best, F.count(F.lit(1)).alias("members"))
    again = stored(cards.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "again")
    if not again.isEmpty():
        classes = stored(classes, "classes")
        met = own.select(F.col("card.id").alias("id"), "class").join(again, "id", "left_semi").join(classes.select("class", "component"), "class").select(F.col("id").alias("a"), F.col("component").alias("b"))
        joined = components(met).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        of_all = classes.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component"))
        classes = of_all.groupBy("component").agg(F.min_by("best", "best.rank").alias("best"), F.sum("members").alias("members"))
    return classes.select("best.card.*", "component", "members")


#: More firms than this start with a word that identifies none of them alone.
COMMON = 20


def across(cards: DataFrame, title: str, rank: list[Column], common: int = COMMON) -> DataFrame:
    """DUP-02: the best card of each cluster of one title, with members. Two cards are one posting if they come from different portals, their
    hubs overlap and their firms' names mean one firm (`same_firm`); clusters are transitive.

    cards: id, portal, hubs, firm. A title's cards are compared through what they must share, a hub and a name's first word; cards alike in
    portal, hubs and firm are one before that, so copies make no pairs. Words that more than `common` firms start with mean none alone.
    """
    kind = ["__title", "portal", "hubs", "firm"]
    named = cards.withColumn("__title", F.col(title)).withColumn("hubs", F.array_sort(F.array_distinct("hubs")))
    keyed = stored(named.groupBy(*kind).agg(F.min("id").alias("first")), "kinds")
    heads = shared_heads(cards, "firm", common).withColumn("shared", F.lit(True))
    headed = keyed.withColumn("word", F.get(identity_tokens(F.col("firm")), F.lit(0))).join(heads, "word", "left")
    spread = headed.select("*", F.explode("hubs").alias("hub"))
    side = lambda n: spread.select("__title", "hub", "word", F.struct("first", "portal", "firm", "shared").alias(n))
    met = side("l").join(side("r"), ["__title", "hub", "word"]).where((F.col("l.first") < F.col("r.first")) & (F.col("l.portal") != F.col("r.portal")) & same_firm(F.col("l.firm"), F.col("r.firm"), F.col("l.shared")))
    linked = met.select(F.col("l.first").alias("a"), F.col("r.first").alias("b")).distinct()
    # cards of one kind match the same others, so where a kind has a partner all its cards are in one cluster; without one they aren't
    whole = components(linked).withColumnRenamed("node", "first")
    own = named.join(keyed.join(whole, "first"), kind, "left").withColumn("component", F.coalesce("component", "id"))
    w = Window.partitionBy("component")
    return own.withColumn("__r", F.row_number().over(w.orderBy(*rank))).withColumn("members", F.count(F.lit(1)).over(w)).where("__r = 1").drop("__r", "__title", "first")


def length_bound(a: Column, b: Column, least: float) -> Column:
    """Whether two texts' lengths allow a ratio of matching characters of `least`: it is at most 2 * shorter / both."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


#: Texts of one bucket of lengths that meet in one task at most: buckets of more are split.
CROWD = 256
#: From so many different texts in a block on they are compared with one of them first, so many times at most.
STARS, STAR_ROUNDS = 8, 4


def profiled(cards: DataFrame, text: str, least: float) -> DataFrame:
    """cards without the text, with its length n, its histogram h and its bucket of lengths z: of two texts that may match the shorter has at least
    least / (2 - least) of the longer's length, so the longer one's bucket is the same or the next."""
    n = F.length(text)
    return cards.where(n > 0).select(*[c for c in cards.columns if c != text], n.alias("n"), runs.histogram(F.col(text)).alias("h"), F.floor(F.log(n) / math.log((2 - least) / least)).alias("z"))


def _may(least: float) -> Column:
    """Whether l and r (n and h) may have a ratio of `least`: lengths first."""
    shorter, both = F.least("l.n", "r.n"), F.col("l.n") + F.col("r.n")
    return (2 * shorter >= least * both) & runs.within_bound(F.col("l.h"), F.col("r.h"), least)


def likely_pairs(cards: DataFrame, key: str, least: float, part: str = "id") -> DataFrame:
    """Pairs a < b of ids of one key and different `part` whose texts' lengths and letters allow a ratio of `least`; cards are profiled.

    Texts meet by key and bucket of lengths, where the longer one looks in its own bucket and the one below. A crowded bucket is split: each
    shorter text is in one part of it, each longer one in all. What pairs carry is a histogram, no text.
    """
    crowd = cards.groupBy(key, "z").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
    side = lambda n: F.struct("n", "id", "h", F.col(part).alias("own")).alias(n)
    short = cards.join(crowd, [key, "z"]).select(key, "z", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), side("l"))
    long = cards.withColumn("z", F.explode(F.array("z", F.col("z") - 1))).join(crowd, [key, "z"])
    long = long.select(key, "z", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), side("r"))
    order = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") < F.col("r.id")))
    on = reduce(and_, [F.col(f"s.{c}") == F.col(f"g.{c}") for c in (key, "z", "part")])
    met = short.alias("s").join(long.alias("g"), on & order & (F.col("l.own") != F.col("r.own")) & _may(least))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))


def _scores(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Each pair's bound, and its ratio where the bound allows `least`."""
    for batch in batches:
        bounds = [runs.letters_bound(x, y) for x, y in zip(batch["tx"], batch["ty"], strict=True)]
        ratios = [runs.ratio(x, y) if bound >= least else None for x, y, bound in zip(batch["tx"], batch["ty"], bounds, strict=True)]
        yield pd.DataFrame({"x": batch["x"], "y": batch["y"], "bound": bounds, "ratio": pd.array(ratios, dtype="Float64")})


SCORES = "x string, y string, bound double, ratio double"


def known_scores(spark: SparkSession, store: str | None) -> DataFrame:
    """SIM-02: the scores that earlier runs left in a folder; none without one."""
    if store is None or publish.current_name(spark, store) is None:
        return spark.createDataFrame([], SCORES)
    return publish.current(spark, store).select("x", "y", "bound", "ratio")


def scored(pairs: DataFrame, texts: DataFrame, least: float, known: DataFrame) -> DataFrame:
    """SIM-01, SIM-02: x, y, bound and ratio of ordered pairs (x, y) of digests; texts has digest and text.

    Known scores are found by an equi-join before any pair is scored; what is missing is scored, dealt out by pairs, so a text of many pairs
    is many tasks' work. A score is exact, whatever `least` is; a pair whose letters don't allow `least` has a bound and no ratio,
    and is scored later if a smaller one asks.
    """
    asked = stored(pairs.select("x", "y").distinct(), "asked")
    have = known.join(asked, ["x", "y"], "left_semi").where(F.col("ratio").isNotNull() | (F.col("bound") < least))
    missing = asked.join(have.select("x", "y"), ["x", "y"], "left_anti")
    own = texts.groupBy("digest").agg(F.first("text").alias("text"))
    given = missing.join(own.select(F.col("digest").alias("x"), F.col("text").alias("tx")), "x").join(own.select(F.col("digest").alias("y"), F.col("text").alias("ty")), "y")
    return stored(have.unionByName(given.repartition("x", "y").mapInPandas(lambda it: _scores(it, least), SCORES)), "scores")


def near(cards: DataFrame, block: list[str], text: str, least: float = 0.93) -> DataFrame:
    """a, b and ratio of cards in a block whose texts' ratio of matching runs is `least` or more; lengths and letters are compared first."""
    own = stored(cards.select("id", F.sha2(F.to_json(F.struct(*block)), 256).alias("key"), F.col(text).alias("t"), F.sha2(text, 256).alias("digest")), "cards")
    digests = own.select("id", "digest")
    likely = likely_pairs(stored(profiled(own.drop("digest"), "t", least), "profiles"), "key", least)
    pairs = stored(likely.join(digests.withColumnsRenamed({"id": "a", "digest": "x"}), "a").join(digests.withColumnsRenamed({"id": "b", "digest": "y"}), "b"), "pairs")
    told = scored(pairs, own.select("digest", F.col("t").alias("text")), least, known_scores(cards.sparkSession, None))
    return pairs.join(told, ["x", "y"]).where(F.col("ratio") >= least).select("a", "b", "ratio")


def _star(rows: DataFrame, least: float) -> DataFrame:
    """a and b of each crowded key's hub and its texts of other classes that it may match. The hub is the smallest id that no hub's class has yet."""
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), F.min_by(F.struct("id", "n", "h", "class"), F.when(~F.col("starred"), F.col("id"))).alias("l"), F.min(F.when(~F.col("starred"), F.col("id"))).alias("__hub"))
    hubs = crowded.where((F.col("__n") >= STARS) & F.col("__hub").isNotNull()).select("key", "l")
    side = rows.select("key", F.struct("id", "n", "h", "class").alias("r"))
    met = hubs.alias("s").join(side.alias("g"), (F.col("s.key") == F.col("g.key")) & (F.col("l.class") != F.col("r.class")) & _may(least))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), F.col("s.key").alias("key"), F.col("l.class").alias("hub"))


def near_classes(cards: DataFrame, block: list[str], text: str, least: float = 0.93, shortest: int = 400, store: str | None = None) -> DataFrame:
    """id, component (smallest id of its class), members and kept (whether it is that id) of every card.

    Classes are transitive: cards of a block whose texts have `shortest` characters at least and match as in near, in an order in which
    two of their cards stand (the ratio isn't symmetric). Equal texts of a block are one text before pairs are made. A crowded block's
    texts are compared with one of them, then with one that isn't of its class, and so on a few times; after that only texts of different
    classes are, so a crowd of near copies makes no pairs of all with all. No pair that could join two classes is left out. Shorter cards
    and those without a text are classes of their own; a null in the block equals a null.

    store: a folder of scores. What earlier runs left there isn't scored again; the scores that this run used become its current version, so
    pairs that are gone fall out.
    """
    spark = cards.sparkSession
    key = F.sha2(F.to_json(F.struct(*block)), 256)
    keyed = stored(cards.where(F.length(text) >= shortest).select("id", key.alias("key"), F.sha2(text, 256).alias("digest")), "keyed")
    firsts = stored(keyed.groupBy("key", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last")), "firsts")
    several = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    read = firsts.join(several, "key", "left_semi").select(F.col("first").alias("id"), "key", "digest", "last")
    texts = stored(cards.select("id", F.col(text).alias("t")).join(read, "id").select("id", "key", "digest", "last", "t"), "texts")
    known, used = known_scores(spark, store), []

    def linked(likely: DataFrame) -> DataFrame:
        """Those of the pairs that match."""
        told = texts.select("id", "digest", "last")
        named = likely.join(told.select(F.col("id").alias("a"), F.col("digest").alias("x"), F.col("last").alias("until")), "a").join(told.select(F.col("id").alias("b"), F.col("digest").alias("y")), "b")
        # b's text stands left of a's where a copy of a's text comes after b
        back = named.where("b < until").select(*likely.columns, F.col("y").alias("x"), F.col("x").alias("y"))
        both = stored(named.drop("until").unionByName(back), "pairs")
        used.append(scored(both, texts.select("digest", F.col("t").alias("text")), least, known))
        return both.join(used[-1], ["x", "y"]).where(F.col("ratio") >= least).select(*likely.columns).distinct()

    rows = stored(profiled(texts, "t", least).select("id", "key", "n", "h", "z", F.col("id").alias("class"), F.lit(False).alias("starred")), "profiles")
    for _ in range(STAR_ROUNDS):
        star = stored(_star(rows, least), "star")
        if star.isEmpty():
            break
        # a key has one hub, so all classes that match it become one: no search for components
        met = linked(star).join(rows.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a").join(rows.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b")
        into = met.select("key", "hub", F.explode(F.array("ca", "cb")).alias("__class")).unionByName(star.select("key", "hub", F.col("hub").alias("__class"))).distinct()
        least_of = into.groupBy("key").agg(F.min("__class").alias("__least"))
        moved = into.join(least_of, "key").select(F.col("__class"), "__least")
        rows = stored(rows.join(moved, F.col("class") == F.col("__class"), "left").select("id", "key", "n", "h", "z", F.coalesce("__least", "class").alias("class"), (F.col("starred") | F.col("__least").isNotNull()).alias("starred")), "profiles")
    rest = linked(likely_pairs(rows, "key", least, "class"))
    links = rest.unionByName(rows.where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b")))
    whole = components(links).withColumnRenamed("node", "first")
    if store is not None:
        publish.publish(reduce(DataFrame.unionByName, used).distinct(), store)
    own = keyed.select("id", "key", "digest").join(firsts, ["key", "digest"]).join(whole, "first", "left").select("id", F.coalesce("component", "first").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    found = cards.select("id").join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return found.select("id", "component", F.count(F.lit(1)).over(Window.partitionBy("component")).alias("members"), (F.col("id") == F.col("component")).alias("kept"))


def stacked(cards: pd.DataFrame) -> pd.DataFrame:
    """The cards (id, firm, name, shared: whether many firms' names start as this one does) of one title and place with `similar`, the smallest id of their stack; alone it is null.

    A card joins the first stack with all of whose members it matches, in the order of ids (complete link: aliases form no chain).
    """
    from ..functions.text import LEGAL

    def words(name: str) -> list[str]:
        return [w for w in name.lower().split() if len(w) > 1 and w not in LEGAL]

    def same(x, y) -> bool:
        if x.firm == y.firm:
            return True
        a, b = words(x.name or ""), words(y.name or "")
        return len(a) > 1 and a[:2] == b[:2] or bool(a and b and a[0] == b[0] and len(a[0]) >= LONE_NAME and not x.shared)

    stacks: list[list] = []
    kinds: dict[tuple, int] = {}
    for card in cards.sort_values("id").itertuples():
        kind = (card.firm, card.name)
        at = kinds.get(kind)
        if at is None:
            at = next((k for k, s in enumerate(stacks) if all(same(card, other) for other in s)), len(stacks))
            if at == len(stacks):
                stacks.append([])
            kinds[kind] = at
            stacks[at].append(card)
    owner = [kinds[(f, n)] for f, n in zip(cards["firm"], cards["name"], strict=True)]
    own = cards.assign(stack=owner)
    size = own.groupby("stack")["id"].transform("size")
    least = own.groupby("stack")["id"].transform("min")
    return pd.DataFrame({"id": own["id"], "similar": least.where(size > 1)}).astype({"similar": "Int64"})


def stacks(cards: DataFrame, title: str, place: str, common: int = COMMON) -> DataFrame:
    """DUP-04: id and similar of cards (id, firm, name) of one title and place; without a title, place or firm a card stands alone.

    Greedy in the order of ids. One row for each different (firm, name) of a title and place goes to its task, so copies cost nothing there.
    """
    good = (F.col(title) != "") & (F.col(place) != "") & F.col("firm").isNotNull()
    named = cards.select("id", "firm", F.coalesce("name", F.lit("")).alias("name"), F.col(title).alias("__t"), F.col(place).alias("__p")).where(good)
    kinds = named.groupBy("__t", "__p", "firm", "name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    heads = shared_heads(named, "name", common).withColumn("shared", F.lit(True))
    kinds = kinds.withColumn("word", F.get(identity_tokens(F.col("name")), F.lit(0))).join(heads, "word", "left")
    kinds = stored(kinds.drop("word").withColumn("shared", F.coalesce("shared", F.lit(False))), "kinds")

    def stack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = stacked(group)
        least = out["similar"].fillna(group["id"]).astype("int64")
        total = group.assign(least=least).groupby("least")["n"].transform("sum")
        return pd.DataFrame({"__t": group["__t"], "__p": group["__p"], "firm": group["firm"], "name": group["name"], "similar": least.where(total > 1)}).astype({"similar": "Int64"})

    told = kinds.groupBy("__t", "__p").applyInPandas(stack, "__t string, __p string, firm string, name string, similar long")
    own = named.join(stored(told, "stacks"), ["__t", "__p", "firm", "name"]).select("id", "similar")
    return cards.select("id").join(own, "id", "left")
