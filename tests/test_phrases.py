"""The phrase index against plain search, small and large, in the plan and joined."""

import random

import pytest
from pyspark.sql import functions as F

from jobstrata.functions import phrases
from jobstrata.functions import text as tx


def some(seed, n_phrases):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    lists = {}
    for d in ("a", "b"):
        own = list(dict.fromkeys(" ".join(dice.choices(words, k=dice.choice((1, 2, 2, 3)))) for _ in range(n_phrases // 2)))
        lists[d] = {f"v{k}": own[k :: 7] for k in range(7)}
    texts = [(i, " ".join(dice.choices(words, k=dice.randrange(60)))) for i in range(60)] + [(100, None), (101, ""), (100, "w1 the w2")]
    return lists, texts


@pytest.mark.parametrize("n_phrases", [40, 5000])
@pytest.mark.parametrize("how", ["index", "joined", "table"])
def test_hits_are_those_of_plain_search(spark, n_phrases, how, monkeypatch):
    lists, texts = some(n_phrases, n_phrases)
    if how == "joined":
        monkeypatch.setattr(phrases, "INDEX_BYTES", 0)
    terms = phrases.vocabulary(spark, lists)
    want = sorted((i, *row) for i, t in texts for row in terms.rows if t is not None and f" {row[4]} " in f" {t} ")
    df = spark.createDataFrame(texts, "id long, t string").select("id", tx.fold(F.col("t")).alias("f"), F.lit(1).alias("phrase"))
    df = df.withColumn("f", F.when(F.col("id") == 100, F.when(F.trim("f") != "", F.col("f"))).otherwise(F.col("f")))
    got = phrases.hits(df, ["id"], "f", terms.table(spark) if how == "table" else terms)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_phrases_are_filed_under_their_rarest_token(spark):
    lists = {"d": {"v": [f"fluent in l{i}" for i in range(50)] + ["fluent", "in"]}}
    index = phrases.buckets(phrases.vocabulary(spark, lists))
    filed = {e["t"]: len(e["p"]) for cell in index for e in cell}
    assert filed == {f"l{i}": 1 for i in range(50)} | {"fluent": 1, "in": 1}
    assert phrases.buckets(phrases.Terms(())) == [[]]
    texts = spark.createDataFrame([(1, " fluent in ")], "id long, f string")
    assert phrases.hits(texts, ["id"], "f", phrases.Terms(())).count() == 0


def test_the_plan_of_an_index_has_no_join(spark):
    lists, texts = some(1, 200)
    df = spark.createDataFrame(texts, "id long, f string")
    plan = phrases.hits(df, ["id"], "f", phrases.vocabulary(spark, lists))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "from_json" not in plan
