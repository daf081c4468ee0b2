"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations come from the bits alone.

Only DataFrame functions are used. Each document is one row from the scan to the result: no shuffle.

Nulls, empty texts: no words, so `few_words` fails. Repeated rows give repeated rows; other columns of the input are ignored.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: name of the rule -> its place in the bitmask. Places are never used again for another rule.
BITS = {"few_words": 0, "repeated_words": 1, "symbols": 2, "long_words": 3, "short_words": 4, "repeated_lines": 5, "symbol_share": 6}
#: rules whose bits every ledger has; those of later rules are added from the measurements where a policy asks for them.
FIRST = tuple(BITS)[:6]

#: version of the policy -> rules that reject under it.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "long_words"),
    "strict": FIRST,
    "v2": ("few_words", "repeated_words", "symbol_share", "long_words"),
}
POLICY = "v1"


def mask(policy: str) -> int:
    return sum(1 << BITS[rule] for rule in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key of each document with the measurements of its text, each a long.

    n_words, word_chars (code points in words), n_symbols (of `#*$%&|<>`), n_lines (with a word), n_dup_lines (equal to an
    earlier line), n_repeat_words (words in three-word windows that the text has twice or more, the first included).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(key, body.alias("__text")).select("*", words(F.col("__text")).alias("__w"))
    w, t = F.col("__w"), F.col("__text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    triples = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    found = base.select(
        key,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.sort_array(F.slice(triples, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))).alias("__s"),
    )
    s = F.col("__s")
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    kept = [key, "n_words", "word_chars", "n_symbols"]
    spots = found.select(
        *kept,
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(twice, lambda x: x["p"])).alias("__p"),
        F.monotonically_increasing_id().alias("__n"),  # keeps filters on the result from being pushed below, which would compute all anew
    )
    p = F.col("__p")
    new = F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), F.lit(-3))))
    covered = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return spots.select(*kept, "n_lines", "n_dup_lines", F.when(F.col("__n") >= 0, covered).alias("n_repeat_words"))


def failures(rules: tuple[str, ...] = FIRST) -> Column:
    """The bitmask of those of the rules that fail, from the measurements.

    `symbols` can't fail for marks that stand alone, since each is a word, too; `symbol_share` takes the usual one in ten words.
    """
    failed = {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 2 * F.col("n_symbols") > 3 * F.col("n_words"),
        "long_words": F.col("word_chars") > 40 * F.col("n_words"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "symbol_share": 10 * F.col("n_symbols") > F.col("n_words"),
    }
    bits = [F.when(failed[rule], F.lit(1 << place)).otherwise(F.lit(0)) for rule, place in BITS.items() if rule in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, the measurements and fail_bits: the table that policies are applied to later, without the texts."""
    return measured(docs, text, key).withColumn("fail_bits", failures())


def booked(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with the bits of all rules of the policy: an older one lacks those of later rules."""
    more = set(POLICIES[policy]) - set(FIRST)
    return book.withColumn("fail_bits", failures((*FIRST, *more))) if more else book


def decided(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with base_failed and kept: false where a base rule or a rule of the policy fails."""
    book = booked(book, policy)
    hit = lambda name: F.col("fail_bits").bitwiseAND(F.lit(mask(name))) != 0
    return book.withColumns({"base_failed": hit("base"), "kept": ~(hit("base") | hit(policy)), "policy": F.lit(policy)})


def ablation(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents kept if this rule alone were dropped.

    One pass over the bits: counts are summed before they are shuffled, one row a task.
    """
    book = booked(book, policy)
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    counts = book.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(own == 0).alias("n_kept"),
        *[F.count_if(own.bitwiseAND(F.lit(1 << BITS[r])) != 0).alias(f"fail_{r}") for r in POLICIES[policy]],
        *[F.count_if(own == F.lit(1 << BITS[r])).alias(f"only_{r}") for r in POLICIES[policy]],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("n_failed"), (F.col("n_kept") + F.col(f"only_{r}")).alias("n_kept_without")) for r in POLICIES[policy]]))
    return counts.select("n_docs", "n_kept", rows.alias("r")).select("r.rule", "n_docs", "n_kept", "r.n_failed", "r.n_kept_without")


def kept_documents(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of docs, with all their columns, whose text passes the policy."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__body"))
    return decided(ledger(rows, "__body", "__row"), policy).where("kept").select("__row.*")
