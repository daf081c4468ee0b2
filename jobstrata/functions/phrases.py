"""Phrases: which of a list, or of an ordered ladder of lists, a folded text has as whole tokens.

Each phrase is filed under the rarest of its tokens, counted over the vocabulary: it can only stand in a text that has that token. So of a
text the set of its tokens is met with the tokens that something is filed under, and only the phrases filed under those are looked for
in the text, once each. Cost grows with the text and with the phrases that come near, not with the vocabulary.

A vocabulary given as lists is an index inside the plan, up to INDEX_BYTES: a table of buckets by the tokens' CRC-32, read where the row is,
without a join or a shuffle. A larger one, or one that is a table, is joined: tokens are shuffled or met with a broadcast index as Spark
finds it to fit, texts only come to the phrases that are near.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import computed, stored

#: What an index inside the plan may take as JSON.
INDEX_BYTES = 4 << 20
PHRASE = "dimension string, value string, rung int, position int, phrase string"


@dataclass(frozen=True)
class Terms:
    """Folded phrases with their dimension, value, rung and position, in order."""

    rows: tuple[tuple[str, str, int, int, str], ...]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PHRASE)


def vocabulary(spark: SparkSession, lists: dict[str, dict[str, list[str]]]) -> Terms:
    """lists: dimension -> value -> phrases; the order of values is that of the rungs, the order of phrases that within a rung."""
    rows = []
    for dimension, ladder in lists.items():
        phrases = [(value, rung, phrase) for rung, (value, own) in enumerate(ladder.items()) for phrase in own]
        rows += [(dimension, value, rung, position, phrase) for position, (value, rung, phrase) in enumerate(phrases)]
    return Terms(tuple(rows))


def buckets(terms: Terms) -> list[list[dict]]:
    """The index: for each bucket its tokens t with the phrases p that are filed under them."""
    shared = Counter(token for *_, phrase in terms.rows for token in set(phrase.split()))
    filed = defaultdict(list)
    for dimension, value, rung, position, phrase in terms.rows:
        token = min(phrase.split(), key=lambda t: (shared[t], t), default=None)
        if token is not None:
            filed[token].append({"dimension": dimension, "value": value, "rung": rung, "position": position, "phrase": phrase})
    out: list[list[dict]] = [[] for _ in range(1 << max(0, 2 * len(filed) - 1).bit_length())]
    for token, own in filed.items():
        out[zlib.crc32(token.encode()) % len(out)].append({"t": token, "p": own})
    return out


def found(folded: Column, index: list[list[dict]]) -> Column:
    """The phrases of an index that a padded folded text has, as structs, in no order that counts; none of a null."""
    table = F.from_json(F.lit(json.dumps(index)), f"array<array<struct<t:string,p:array<struct<{PHRASE.replace(' ', ':').replace(',:', ',')}>>>>>")  # folded into a literal
    filed = lambda token: F.filter(F.get(table, (F.crc32(token.cast("binary")) % len(index)).cast("int")), lambda e: e["t"] == token)
    there = lambda p: F.contains(folded, F.concat(F.lit(" "), p["phrase"], F.lit(" ")))
    near = F.flatten(F.transform(F.array_distinct(F.split(F.trim(folded), " ")), filed))
    return F.flatten(F.transform(near, lambda e: F.filter(e["p"], there)))


def hits(texts: DataFrame, key: list[str], folded: str, terms: Terms | DataFrame) -> DataFrame:
    """TXT-05 to 08: key, dimension, value, rung, position and phrase of each phrase of the vocabulary in each text.

    terms: lists as `vocabulary` makes them, or a table of the same columns. An empty vocabulary has no hits; a phrase without a token is none.
    """
    columns = ["dimension", "value", "rung", "position", "phrase"]
    if isinstance(terms, Terms):
        index = buckets(terms)
        if len(json.dumps(index)) <= INDEX_BYTES:
            each = computed(texts.select(*key, found(F.col(folded), index).alias("__h")))
            return each.select(*key, F.inline("__h")).select(*key, *columns)
        terms = terms.table(texts.sparkSession)
    named = terms.select(*columns, F.explode(F.array_distinct(F.filter(F.split("phrase", " "), lambda t: t != ""))).alias("__t"))
    shared = terms.select("phrase").distinct().select(F.explode(F.array_distinct(F.split("phrase", " "))).alias("__t")).groupBy("__t").agg(F.count(F.lit(1)).alias("__n"))
    filed = named.join(shared, "__t").groupBy(*columns).agg(F.min(F.struct("__n", "__t"))["__t"].alias("__t"))
    base = stored(texts.select(*key, F.col(folded).alias("__f")).withColumn("__row", F.monotonically_increasing_id()), "texts")
    tokens = base.select("__row", F.explode(F.array_distinct(F.split(F.trim("__f"), " "))).alias("__t"))
    near = tokens.join(filed, "__t").select("__row", *columns)
    return base.join(near, "__row").where(F.contains("__f", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select(*key, *columns)


def first_rung(found: DataFrame, key: list[str]) -> DataFrame:
    """Of each text and dimension the first rung with a phrase, and its first phrase as evidence."""
    return found.groupBy(*key, "dimension").agg(F.min_by(F.struct("value", "phrase"), "position").alias("m")).select(*key, "dimension", "m.value", F.col("m.phrase").alias("evidence"))


def every_rung(found: DataFrame, key: list[str]) -> DataFrame:
    """Of each text and dimension every rung with a phrase, with its first phrase as evidence."""
    return found.groupBy(*key, "dimension", "value").agg(F.min_by("phrase", "position").alias("evidence"))


def every_phrase(found: DataFrame, key: list[str]) -> DataFrame:
    """Of each text and dimension all its phrases, in the vocabulary's order, joined by bars."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "phrase")))
    return found.groupBy(*key, "dimension").agg(F.array_join(F.transform(ordered, lambda x: x["phrase"]), "|").alias("phrases"))
