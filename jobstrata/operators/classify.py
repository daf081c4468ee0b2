"""The classifier: folded texts in, long-format tags (key, dimension, value, confidence, evidence, tagger) out.

The vocabulary is data; its digest is the classifier's version. A dimension without a hit gets an explicit `unknown`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import every_rung, first_rung, hits
from ..functions.text import fold
from .tables import computed

#: dimension -> value -> phrases, in the order of priority. A small one of its own, over words of any prose.
VOCABULARY: Mapping[str, Mapping[str, list[str]]] = {
    "register": {"legal": ["license", "licensed under", "copyright"], "contact": ["mail", "phone", "call"], "prose": ["the", "der", "que", "le"]},
    "topic": {"person": ["he", "she", "who"], "place": ["in", "at", "from"], "thing": ["it", "this", "that"]},
}
MULTIPLE = ("topic",)
STRONG = 200
STOPWORDS = {"en": ["the", "and", "of", "to", "in", "is", "that"], "de": ["der", "die", "und", "das", "zu", "ist", "den"], "es": ["que", "de", "el", "los", "una", "por", "las"], "fr": ["le", "les", "des", "et", "est", "en", "que"]}


def version(vocabulary: Mapping = VOCABULARY) -> str:
    return hashlib.blake2b(json.dumps(vocabulary, sort_keys=True).encode(), digest_size=8).hexdigest()


def tagged(rows: DataFrame, terms: DataFrame, key: list[str], text: str, dimensions: list[str], multiple: tuple[str, ...] = MULTIPLE, tagger: int = 1) -> DataFrame:
    """Tags of rows: one value of a ladder by its order, every value of the `multiple` dimensions; strong where the text is long."""
    base = rows.select(*key, fold(F.col(text)).alias("__f"), F.when(F.length(text) > STRONG, "strong").otherwise("weak").alias("confidence"))
    found = hits(base, key, "__f", terms)
    one = first_rung(found.where(~F.col("dimension").isin(*multiple)), key).select(*key, "dimension", "value", "evidence")
    many = every_rung(found.where(F.col("dimension").isin(*multiple)), key).select(*key, "dimension", "value", "evidence")
    every = one.unionByName(many)
    whole = base.select(*key, "confidence", F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
    out = whole.join(every, [*key, "dimension"], "left")
    return out.select(*key, "dimension", F.coalesce("value", F.lit("unknown")).alias("value"), "confidence", "evidence", F.lit(tagger).alias("tagger"))


def found_phrases(folded: Column, phrases: list[str]) -> Column:
    """Those of the phrases that a padded folded text has as whole tokens, in their order: words by intersection, runs of words by search."""
    words = [p for p in phrases if " " not in p]
    runs = [p for p in phrases if " " in p]
    one = F.array_intersect(F.array(*[F.lit(p) for p in words]).cast("array<string>"), F.split(F.trim(folded), " "))
    return F.concat(one, F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(f" {p} ")), p) for p in runs]))) if runs else one


def tag_list(found: Column, confidence: Column, vocabulary: Mapping[str, Mapping[str, list[str]]] = VOCABULARY, multiple: tuple[str, ...] = MULTIPLE) -> Column:
    """The tags (dimension, value, confidence, evidence) that found phrases give: one value of a ladder by its order, every value of the
    `multiple` dimensions, `unknown` where there is none. One expression a row: no join and no shuffle."""
    tag = lambda d, v, e: F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), confidence.alias("confidence"), e.alias("evidence"))
    parts = []
    for dimension, ladder in vocabulary.items():
        proof = {v: F.get(F.array_intersect(F.array(*[F.lit(p) for p in phrases]), found), F.lit(0)) for v, phrases in ladder.items()}
        hits = [F.when(e.isNotNull(), tag(dimension, v, e)) for v, e in proof.items()]
        unknown = tag(dimension, "unknown", F.lit(None).cast("string"))
        if dimension in multiple:
            own = F.array_compact(F.array(*hits))
            parts.append(F.when(F.size(own) > 0, own).otherwise(F.array(unknown)))
        else:
            parts.append(F.array(F.coalesce(*hits, unknown)))
    return F.concat(*parts)


def with_tags(rows: DataFrame, text: str, vocabulary: Mapping[str, Mapping[str, list[str]]] = VOCABULARY, multiple: tuple[str, ...] = MULTIPLE) -> DataFrame:
    """rows with `tags`, in one pass over the text; for vocabularies of some hundred phrases, `tagged` takes larger ones.

    Phrases are a column of their own that no filter and no generator above computes anew, so the text is folded once.
    """
    every = list(dict.fromkeys(p for ladder in vocabulary.values() for phrases in ladder.values() for p in phrases))
    kept = [c for c in rows.columns if c != text]
    folded = rows.select(*kept, fold(F.col(text)).alias("__f"), F.when(F.length(text) > STRONG, "strong").otherwise("weak").alias("__c"))
    found = computed(folded.select(*kept, "__c", found_phrases(F.col("__f"), every).alias("__p")))
    return found.select(*kept, tag_list(F.col("__p"), F.col("__c"), vocabulary, multiple).alias("tags"))


def pending(rows: DataFrame, tags: DataFrame, key: list[str], tagger: int) -> DataFrame:
    """Rows without a tag of the current version."""
    return rows.join(tags.where(F.col("tagger") == tagger).select(*key).distinct(), key, "left_anti")


def _among(values: list[str]):
    return lambda w: w.isin(*values)


def language(rows: DataFrame, key: list[str], text: str, least: int = 4) -> DataFrame:
    """key, language and votes: the language most of whose stopwords a text has, by occurrences; `en` before others on ties, then by name."""
    base = rows.select(*key, F.split(F.trim(fold(F.col(text))), " ").alias("__w"))
    votes = {lang: F.size(F.filter("__w", _among(stop))) for lang, stop in STOPWORDS.items()}
    each = F.array(*[F.struct((-n).alias("n"), F.lit(lang != "en").alias("other"), F.lit(lang).alias("lang")) for lang, n in votes.items()])
    best = F.array_min(each)
    return base.select(*key, best.alias("b")).select(*key, F.when(-F.col("b.n") >= least, F.col("b.lang")).otherwise("unknown").alias("language"), (-F.col("b.n")).cast("long").alias("votes"))
