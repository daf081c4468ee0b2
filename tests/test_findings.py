"""Findings of later rounds: classes of equal keys against all pairs, and over a crowd that pairs would never end on."""

import random
import re
import threading
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from jobstrata.functions import names as nm
from jobstrata.functions import text as tx
from jobstrata.operators import dedup
from jobstrata.plans import catalogue

from .test_advice import clusters

NAMES = ("Nordic Bank AB", "nordic light", "Ab Cd Ef", "ab cd", "ab ce", "a b cd", "Abcd X", "abcd", "Ltd", "AB Volvo", "volvo", "Åland Ferries", "", "...", "Cd Ab", None)


def same(spark):
    """The pairs of names that same_company says are one's."""
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    both = names.select(F.col("n").alias("a")).crossJoin(names.select(F.col("n").alias("b"))).where(tx.same_company(F.col("a"), F.col("b")))
    return {(r["a"], r["b"]) for r in both.collect()}


def test_a_key_says_the_same_as_pairs_of_names(spark):
    told = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", tx.company_key(F.col("n")).alias("k")).collect()}
    assert {(a, b) for a in NAMES for b in NAMES if told[a] is not None and told[a] == told[b]} == same(spark)


@pytest.mark.parametrize("ids", [400, 60])  # with 60, most ids are those of several cards
def test_classes_are_those_of_all_pairs(spark, ids):
    rng, alike = random.Random(ids), same(spark)
    whole = list(range(ids)) if ids == 400 else [rng.choice([None, *range(ids)]) for _ in range(90)]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None]), rng.choice(NAMES), rng.choice([None, float("nan"), 1.0, 2.0])) for i in whole]
    named = [r for r in rows if r[0] is not None]
    pairs = [(a[0], b[0]) for a, b in combinations(named, 2) if a[0] != b[0] and a[1] is not None and a[1] == b[1] and a[2] is not None and a[2] == b[2] and (a[3], b[3]) in alike]
    root = clusters([r[0] for r in named], pairs)
    groups: dict = {}
    for r in rows:
        groups.setdefault(None if r[0] is None else root[r[0]], []).append(r)
    rank = lambda r: (r[4] is not None, r[4] != r[4], 0 if r[4] is None or r[4] != r[4] else r[4], r[0] or 0)
    want = sorted((repr(min(g, key=rank)[0]), len(g)) for g in groups.values())
    cards = spark.createDataFrame(rows, "id long, brand string, size int, firm string, price double")
    got = dedup.classed(cards, ["brand", "size", tx.company_key(F.col("firm"))], [F.col("price"), F.col("id")])
    assert sorted((repr(r["id"]), r["members"]) for r in got.collect()) == want


def within(spark, seconds, run):
    """What run returns; its jobs are cancelled, and it fails, if it takes longer."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


def test_a_crowded_block_makes_no_pairs(spark, tmp_path):
    """200,000 parts of one block and name would be 20 thousand million pairs."""
    one = [F.lit(v).alias(c) for c, v in (("p_name", "hot bolt"), ("p_brand", "b"), ("p_type", "t"), ("p_size", 1))]
    spark.range(200_000).select(F.col("id").alias("p_partkey"), *one, (F.col("id") % 7 + 1.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    got = within(spark, 60, lambda: catalogue.queries()["dup_cross"](spark, str(tmp_path)).collect())
    assert [(r["id"], r["members"]) for r in got] == [(0, 200_000)]


def folded_years(text, most=30):
    """experience_floor in Python."""
    w = [""] * 6 + text.strip(" ").split(" ")
    number, at = re.compile("[0-9]{1,2}[+]?").fullmatch, lambda i: w[i] if 0 <= i < len(w) else ""
    found = []
    for i in range(6, len(w)):
        if w[i] in nm.YEAR_WORDS:
            k = i - 2 if w[i - 1] == "+" else i - 1
            low = k - 1 if number(at(k - 1)) else k - 2 if at(k - 1) in ("to", "or") and number(at(k - 2)) else k
            asked = k < i - 1 or "+" in at(k) or low < k or set(w[low - 3 : low]) & set(nm.ASKING) or "experience" in w[i + 1 : i + 5]
            if number(at(k)) and asked:
                found.append(int(at(low).replace("+", "")))
    return min([y for y in found if y <= most], default=None)


def told_duties(text, verbs):
    """duties in Python."""
    parts = [re.sub("[^a-z0-9+#]+", " ", p.lower()).strip(" ") for p in re.split(r"[\n;:]+|[.!?]+(?:\s+|$)", re.sub("<[^>]*>", "\n", text))]
    parts = [p for p in parts if p]
    ruled, on, out = any(p in nm.WORK_HEADS for p in parts), False, []
    for p in parts:
        if p in nm.WORK_HEADS or p in nm.OTHER_HEADS:
            on = p in nm.WORK_HEADS
        elif set(p.split(" ")) & set(verbs) and (on if ruled else p.split(" ")[0] not in nm.FIRM_FIRST):
            out.append(p)
    return out


def test_years_and_duties_are_those_of_plain_loops(spark):
    rng = random.Random(4)
    words = ["3", "5+", "10", "+", "to", "or", "years", "yrs", "year", "yr", "at", "least", "minimum", "over", "experience", "99", "of", "yearly", "123"]
    says = ["build things", "We build", "our model", "Your tasks", "REQUIREMENTS", "About us", "nothing", "run <b>fast</b>", "Answer ü tickets", "", "the work", "deploy C++ & C#", "<i"]
    years = [" " + " ".join(rng.choices(words, k=rng.randrange(0, 14))) + " " for _ in range(400)]
    texts = ["".join(rng.choice(says) + rng.choice([". ", ": ", "; ", "\n", "!? ", ".", "<p>", " "]) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    verbs = ("build", "deploy", "answer", "run", "model")
    df = spark.createDataFrame(list(zip(years, texts, strict=True)), "y string, t string")
    got = df.select("y", "t", nm.experience_floor(F.col("y")).alias("floor"), nm.duties(F.col("t"), verbs).alias("own")).collect()
    assert [r["floor"] for r in got] == [folded_years(r["y"]) for r in got]
    assert [r["own"] for r in got] == [told_duties(r["t"], verbs) for r in got]
    assert any(r["floor"] is not None for r in got) and any(r["own"] for r in got)
    none = spark.createDataFrame([(None,)], "t string").select(nm.experience_floor(F.col("t")).alias("f"), nm.duties(F.col("t"), verbs).alias("d")).first()
    assert none["f"] is None and none["d"] is None


def test_what_two_columns_fold_to_is_that_of_both(spark):
    odd = [None, "", " ", "C++", "c#", "Straße & ÆSIR", "a <b", "b> c", "<p>x</p>", "+", "# 1", "5+ yrs", "ÀÉ\n", "ΑΣ", "İ"]
    df = spark.createDataFrame([(a, b) for a in odd for b in odd], "a string, b string")
    t = df.withColumns({"ta": tx.bound(F.col("a"), lambda v: tx.fold(v)), "tb": tx.fold(F.col("b"))}).select("*", tx.fold(F.col("a")).alias("plain"))
    bad = t.where((F.col("ta") != F.col("plain")) | (tx.fold_both("a", "b", "ta", "tb") != tx.fold(F.col("a"), F.col("b"))))
    assert bad.count() == 0 and t.where("ta IS NULL").isEmpty()


def test_years_of_a_long_text(spark):
    """each token was read from a text split anew."""
    text = spark.range(8).select(F.concat(F.lit(" "), F.repeat(F.lit("word "), 60_000), F.lit("at least "), F.col("id") % 1 + 4, F.lit(" years ")).alias("x"))
    got = within(spark, 60, lambda: text.select(nm.experience_floor(F.col("x")).alias("y")).collect())
    assert {r["y"] for r in got} == {4}


def test_duties_of_a_long_text(spark):
    """each statement was looked at with all of them folded anew."""
    text = spark.range(8).select(F.concat(F.lit("The work: build a. "), F.repeat(F.lit("we keep b. "), 4_000), F.lit("Profile: run")).alias("x"))
    got = within(spark, 60, lambda: text.select(nm.duties(F.col("x"), ("build", "keep", "run")).alias("d")).collect())
    assert {(len(r["d"]), r["d"][0], r["d"][-1]) for r in got} == {(4_001, "build a", "we keep b")}
