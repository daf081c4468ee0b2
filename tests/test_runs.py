"""Matching runs against the standard library's matcher; scores that are kept."""

import random
from difflib import SequenceMatcher, get_close_matches
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from jobstrata.functions import runs
from jobstrata.operators import dedup, publish

from .test_advice import clusters


def texts(n, seed):
    dice = random.Random(seed)
    for _ in range(n):
        letters = "ab cdé😀"[: dice.choice((2, 3, 7))]
        a, b = ("".join(dice.choices(letters, k=dice.randrange(40))) for _ in "ab")
        yield a, a[: dice.randrange(len(a) + 1)] + b[:3] + a[dice.randrange(len(a) + 1) :] if dice.random() < 0.5 else b


def test_runs_are_those_of_the_matcher():
    for a, b in texts(1500, 1):
        plain = SequenceMatcher(None, a, b, autojunk=False)
        best = plain.find_longest_match()
        assert runs.longest_run(a, b) == (best.size, best.a, best.b) or not best.size
        assert runs.ratio(a, b) == plain.ratio() and runs.letters_bound(a, b) == plain.quick_ratio()


def test_histograms_never_cut_off_a_match(spark):
    pairs = list(texts(200, 2))
    df = spark.createDataFrame(pairs, "a string, b string")
    h = runs.histogram
    for least in (0.5, 0.9):
        got = df.select("a", "b", runs.within_bound(h(F.col("a")), h(F.col("b")), least).alias("may")).collect()
        assert all(r["may"] for r in got if runs.letters_bound(r["a"], r["b"]) >= least)
        assert not all(r["may"] for r in got)


def test_nearest_value_is_not_that_of_fewest_edits(spark):
    allowed = ["adjacent", "less_relevant", "rejected", "relevant", "unknown"]
    typed = ["rejectec", "slightly", "relevnat", "adjacen", "nkunown", "", None, "relevant", "tnavel", "xrelevantx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "i int, v string")
    got = [r["nearest"] for r in runs.nearest(df, "v", allowed).orderBy("i").collect()]
    assert got == [next(iter(get_close_matches(t, allowed, 1, 0.85)), None) if t else None for t in typed]
    assert got[:4] == ["rejected", None, "relevant", "adjacent"]
    # two edits of eight letters either way, but the swapped pair leaves one letter unmatched only
    assert runs.ratio("relevant", "relevnat") > 0.85 > 1 - 2 / 8
    assert runs.nearest(df, "v", []).where("nearest IS NOT NULL").count() == 0


@pytest.fixture
def cards(spark):
    dice = random.Random(4)
    base = ["".join(dice.choices("abcdef gh", k=dice.choice((60, 64, 90)))) for _ in range(6)]
    rows = []
    for i in range(70):
        t = list(dice.choice(base))
        for _ in range(dice.choice((0, 1, 2, 9))):
            t[dice.randrange(len(t))] = dice.choice("xyz")
        rows.append((i, "k" if i % 9 else None, "".join(t)))
    return rows + [(100, "k", None), (101, "k", ""), (102, "k", "short")], "id long, k string, text string"


@pytest.mark.parametrize("crowd", [256, 3])
def test_crowded_blocks_are_split_and_lose_no_pair(spark, cards, crowd, monkeypatch):
    monkeypatch.setattr(dedup, "CROWD", crowd)
    rows, schema = cards
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] == b[1] and a[2] and b[2] and SequenceMatcher(None, a[2], b[2], autojunk=False).ratio() >= 0.93}
    got = [(r["a"], r["b"]) for r in dedup.near(spark.createDataFrame(rows, schema).repartition(3), ["k"], "text").collect()]
    assert set(got) == want and len(got) == len(want) > 20


@pytest.mark.parametrize(("stars", "rounds"), [(1000, 0), (2, 1), (2, 9)])
def test_classes_are_those_of_all_pairs(spark, cards, stars, rounds, monkeypatch):
    monkeypatch.setattr(dedup, "STARS", stars)
    monkeypatch.setattr(dedup, "STAR_ROUNDS", rounds)
    rows, schema = cards
    rows = rows + [(200 + i, "k", rows[i][2]) for i in range(0, 60, 7)]
    long = [r for r in rows if r[2] and len(r[2]) >= 10]
    pairs = [(a[0], b[0]) for a, b in combinations(long, 2) if a[1] == b[1] and SequenceMatcher(None, a[2], b[2], autojunk=False).ratio() >= 0.93]
    root = clusters([r[0] for r in rows], pairs)
    got = {r["id"]: (r["component"], r["members"]) for r in dedup.near_classes(spark.createDataFrame(rows, schema).repartition(3), ["k"], "text", shortest=10).collect()}
    assert got == {i: (c, list(root.values()).count(c)) for i, c in root.items()}


def test_kept_scores_are_not_computed_again(spark, cards, tmp_path, monkeypatch):
    rows, schema = cards
    df, store = spark.createDataFrame(rows, schema), str(tmp_path / "scores")
    classes = lambda d, **more: {(r["id"], r["component"]) for r in dedup.near_classes(d, ["k"], "text", shortest=10, **more).collect()}
    first = classes(df, store=store)
    assert first == classes(df) and publish.current(spark, store).where("ratio IS NOT NULL").count() > 20
    version = publish.current(spark, store).orderBy("x", "y").collect()

    def none(batches, least):
        for b in batches:
            if len(b):
                raise AssertionError("a pair was scored again")
            yield b

    monkeypatch.setattr(dedup, "_scores", none)
    assert classes(df, store=store) == first and publish.current(spark, store).orderBy("x", "y").collect() == version
    classes(df.where("id < 30"), store=store)
    assert 0 < publish.current(spark, store).count() < len(version)  # pairs that are gone fall out
    with pytest.raises(Exception, match="scored again"):
        classes(df, store=store)
