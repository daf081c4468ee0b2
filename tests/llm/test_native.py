"""Quality rules, decontamination and personal data against plain versions, on whole tables and odd rows."""

import pytest
from pyspark.sql import functions as F

from jobstrata.llm import decontam, pii, rules

from . import brute
from .helpers import differences, documents


def test_rules(spark, sf):
    rows, df = documents(spark, sf)
    assert not differences(rules.decided(rules.ledger(df)), brute.rules(rows))


def test_ablation_counts_what_a_rule_alone_rejects(spark, sf):
    _, df = documents(spark, sf)
    book = rules.decided(rules.ledger(df))
    kept = book.where("kept").count()
    for r in rules.ablation(book).collect():
        bit = 1 << rules.BITS[r["rule"]]
        assert (r["n_kept"], r["n_kept_without"]) == (kept, book.where((F.col("fail_bits").bitwiseAND(F.lit(rules.mask(rules.POLICY) & ~bit)) == 0)).count())


def test_kept_documents_keep_all_columns(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "x", 3), (2, "short", None, None), (3, None, None, None)], "doc_id long, text string, n_words string, __w int")
    assert [tuple(r)[2:] for r in rules.kept_documents(df).collect()] == [("x", 3)]


def test_personal_data(spark, sf):
    odd = ["a@b.c.+x@y.z a@b.com@c.org 1.2.3.4.5 256.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 12 +4915112345678", "é@ü.de foo@bar.baz-x.q.. \U0001f600 a@b.cc 0004.3.2.1", " ".join(f"u{i}@x.org" for i in range(300)), "1" * 20000, "+1+1+1 ((((", "4111-1111-1111-1111 4111111111111112"]
    rows, df = documents(spark, sf, odd)
    assert not differences(pii.digest(pii.found(df)), brute.pii(rows))


@pytest.mark.parametrize(("text", "kind"), [("iban DE89370400440532013000", "iban"), ("my ssn 123-45-6789 here", "ssn")])
def test_added_kinds_need_check_or_context(spark, text, kind):
    df = spark.createDataFrame([(1, text), (2, text.replace("DE89", "DE88").replace("ssn", "no"))], "doc_id long, text string")
    assert [r[f"n_{kind}"] for r in pii.digest(pii.found(df)).orderBy("doc_id").collect()] == [1, 0]


def test_redaction_covers_overlaps_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "x\U0001f600 a@b.cc, card 4111 1111 1111 1111!", "k"), (2, "nothing", None), (3, None, None)], "doc_id long, text string, email string")
    assert [tuple(r) for r in pii.redacted(df).orderBy("doc_id").collect()] == [(1, "x\U0001f600 [EMAIL], card [CARD]!", "k"), (2, "nothing", None), (3, None, None)]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, sf, limit):
    rows, df = documents(spark, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()] + [(1000, "the of"), (1001, None), (1002, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert not differences(decontam.judged(df, bench, limit=limit), brute.leaked(rows, items))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_a_window_of_many_items_repeated_in_one_text(spark, limit):
    """20,000 items with one line in common, and documents that repeat it: no product of items and places."""
    line = "please choose the one best answer to the question below"
    bench = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit(line + " q"), F.col("id").cast("string")).alias("text"))
    rows = [(1, " ".join([line] * 20_000)), (2, line + " q7"), (2, "another text"), (None, line), (None, "clean"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontam.judged(df, bench, limit=limit).collect()}
    every = ",".join(sorted(map(str, range(20_000))))
    assert {k: (r["n_hit"], r["n_items"]) for k, r in got.items()} == {(1, 200_000): (200_000, 20_000), (2, 11): (11, 20_000), (2, 2): (0, 0), (None, 10): (10, 20_000), (None, 1): (0, 0), (3, 0): (0, 0)}
    assert got[1, 200_000]["items_sha256"] == brute.sha(every)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decontam.clean_documents(df, bench).collect() if r["text"]) == [(0, "clean"), (2, "another text")]


def test_spans_are_cut_and_documents_dropped(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "ab cd")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Before, ONE two three four five six seven eight nine ten; after!", 5), (2, "ab  Cd", 6), (3, "clean text", 7), (4, None, 8)], "doc_id long, text string, hits int")
    assert [(r["text"], r["hits"]) for r in decontam.without_spans(df, bench).orderBy("doc_id").collect()] == [("Before, ; after!", 5), ("", 6), ("clean text", 7), (None, 8)]
    assert [r["doc_id"] for r in decontam.clean_documents(df, bench).orderBy("doc_id").collect()] == [3, 4]


def test_empty_tables(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    _, df = documents(spark, sf)
    assert rules.ledger(none).count() == pii.found(none).count() == decontam.judged(none, bench).count() == 0
    assert decontam.judged(df, bench).where("contaminated").count() == 0
