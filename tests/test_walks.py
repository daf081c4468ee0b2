"""Walks over captured boards: literal boards, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from jobstrata.sources import slices


def told(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_slices_split_until_they_fit(spark):
    rows = [(i, ["a"], "x" if i < 4 else "y", i) for i in range(6)] + [(6, ["a", "b"], None, 6), (7, ["b"], "x", 7), (8, [], "x", 8), (8, [], "x", 8), (9, None, "x", 9)]
    board = spark.createDataFrame(rows, "id long, label array<string>, kind string, age int")
    walk = slices.walked(board, "id", ["label", "kind"], 3, [F.col("age")])
    assert told(walk.leaves.withColumn("slice", F.array_join("slice", "/")), "slice", "hits", "n_read", "truncated") == [("label=a/kind=x", 4, 3, True), ("label=a/kind=y", 2, 2, False), ("label=b", 2, 2, False)]
    assert told(slices.labelled(walk, "id"), "id", "labels", "n_leaves") == [(0, ["a"], 1), (1, ["a"], 1), (2, ["a"], 1), (4, ["a"], 1), (5, ["a"], 1), (6, ["b"], 1), (7, ["b"], 1)]
    # 8 and 9 have no label, 3 lies beyond the window of a slice that nothing splits; 6 was lost by a split, but another slice has it
    assert told(walk.unsplit, "id", "slice") == [(6, ["label=a"]), (8, []), (9, [])]
    assert slices.proof(walk, board, "id").first().asDict() == {"advertised": 10, "seen": 7, "n_leaves": 3, "n_truncated": 1, "n_kept_back": 1, "n_unsplit": 2, "complete": False}


@pytest.mark.parametrize("window", [1, 7, 60, 1000])
def test_a_walk_sees_all_but_what_it_says(spark, window):
    dice = random.Random(window)
    rows = [(i, dice.choice("abc"), dice.choice(["x", "y", "x", None]), str(i % 5), dice.randrange(50)) for i in range(400)]
    board = spark.createDataFrame(rows, "id long, a string, b string, c string, age int").repartition(3)
    walk = slices.walked(board, "id", ["a", "b", "c"], window, [F.col("age")])
    one = slices.proof(walk, board, "id").first()
    assert one["seen"] + one["n_kept_back"] + one["n_unsplit"] == one["advertised"] == 400  # here each row is in one slice at a time
    assert one["complete"] == (window == 1000) and one["n_truncated"] == walk.leaves.where("truncated").count()
    for r in walk.leaves.collect():
        inside = [x for x in rows if all(str(x["abc".index(s[0]) + 1]) == s[2:] for s in r["slice"])]
        got = {x["id"] for x in walk.reached.where(F.col("slice") == F.lit(r["slice"])).collect()}
        assert got == {x[0] for x in sorted(inside, key=lambda x: (x[4], x[0]))[:window]} and r["hits"] == len(inside)
    assert slices.proof(slices.walked(board.limit(0), "id", ["a"], 5, [F.col("age")]), board.limit(0), "id").first()["seen"] == 0


@pytest.mark.parametrize(("reach", "sound"), [(500, True), (90, True), (20, False), (3, False)])
def test_both_ends_of_shorter_and_shorter_windows(spark, reach, sound):
    ages = sorted(random.Random(3).choices(range(9), k=300))
    rows = list(enumerate(ages)) + [(400, None), (401, 9), (402, -1)]
    got = slices.two_ended(spark.createDataFrame(rows, "id long, age int").repartition(4), "id", "age", [], reach, 9).collect()
    want, seen = {}, set()
    for d in range(9, 0, -1):
        held = [i for i, a in enumerate(ages) if a < d]
        for i in held[:reach] + held[-reach:]:
            want.setdefault(i, d)
        seen = set(want)
        if len(seen) == 300:
            break
    assert {r["id"]: r["reached_by"] for r in got} == {i: want.get(i) for i in range(300)}
    assert {r["sound"] for r in got} == {len(seen) == 300} and (len(seen) == 300) == sound


def test_pages_end_well_only_with_an_empty_one(spark):
    walks = {
        "well": ([(200, [1, 2]), (200, [2, 3]), (200, []), (200, [9])], 2, 3, "empty"),
        "round": ([(200, [1, 2]), (200, [3]), (200, [1, 2]), (200, [])], 2, 3, "repeated"),
        "haste": ([(200, [1]), (429, None), (200, [])], 1, 1, "throttled"),
        "broken": ([(200, [1]), (200, None), (200, [])], 1, 1, "failed"),
        "refused": ([(500, [1])], 0, 0, "failed"),
        "on": ([(200, [1]), (200, [5])], 2, 2, "open"),
        "none": ([(200, [])], 0, 0, "empty"),
    }
    rows = [(w, k + 1, s, i) for w, (pages, *_) in walks.items() for k, (s, i) in enumerate(pages)] + [("gap", 1, 200, [1]), ("gap", 3, 200, []), ("gap", 1, 200, [1])]
    pages = spark.createDataFrame(rows, "walk string, page int, status int, ids array<long>")
    got = {r["walk"]: (r["n_pages"], r["n_rows"], r["ended"], r["complete"]) for r in slices.sequences(pages, "walk").collect()}
    assert got == {w: (*want, want[2] == "empty") for w, (_, *want) in walks.items()} | {"gap": (1, 1, "failed", False)}
    assert told(slices.sequence_rows(pages, "walk").where("walk = 'well'"), "id") == [(1,), (2,), (3,)]


def test_parts_that_share_or_lack_keys_are_unsound(spark):
    reads = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "c"), (9, "x")], "id long, part string")
    said = spark.createDataFrame([("a", 2), ("b", 1), ("c", 2), ("d", 1)], "part string, advertised long")
    assert told(slices.shares(reads, "id", "part", said), "part", "got", "shared", "sound") == [("a", 2, 0, True), ("b", 1, 1, False), ("c", 1, 1, False), ("d", 0, 0, False), ("x", 1, 0, False)]


def test_two_hops_find_the_best_page(spark):
    pages = [
        ("a/", True, ["a/jobs"], None), ("a/jobs", True, ["b/board", "a/x"], None), ("b/board", True, [], "v1"),  # two hops in
        ("c/", True, ["c/1", "c/2"], None), ("c/1", False, ["c/9"], "v9"), ("c/2", True, ["c/", None], None),  # an unreadable page has no vendor
        ("d/", True, ["d/1"], "v2"), ("e/", False, ["a/"], "v3"), ("f/", True, [], None), ("g/", True, ["g/none"], None),
        ("h/", True, [f"h/{i}" for i in range(9)], None), *[(f"h/{i}", True, [f"h/deep{i}"], "v4" if i == 7 else None) for i in range(9)], ("h/deep0", True, [], "v5"),
        ("i/", True, ["i/1", "i/2"], None), ("i/1", True, [f"i/{k}" for k in range(3, 9)], None), ("i/2", True, ["i/5", "i/hit"], None), *[(f"i/{k}", True, [], "v6" if k == 6 else None) for k in range(3, 9)],
    ]
    df = spark.createDataFrame(pages + [("a/", False, None, None)], "url string, readable boolean, links array<string>, vendor string")
    sites = spark.createDataFrame([(s, f"{s}/") for s in "abcdefghi"] + [("z", None)], "site string, home string")
    got = {r["site"]: (r["tier"], r["url"], r["vendor"], r["n_fetched"]) for r in slices.two_hops(sites, df).collect()}
    assert got == {
        "a": ("A", "b/board", "v1", 2), "b": ("C", None, None, 0), "c": ("B", "c/2", None, 3), "d": ("A", "d/", "v2", 0), "e": ("C", None, None, 0), "f": ("C", None, None, 0),
        "g": ("C", None, None, 1), "h": ("B", "h/0", None, 6), "i": ("A", "i/6", "v6", 6), "z": ("C", None, None, 0),
    }
