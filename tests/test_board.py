"""Literal cases and plain versions of the board's and the classifier's operators."""

import hashlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from jobstrata.functions import names as nm
from jobstrata.functions import text as tx
from jobstrata.operators import boards, cascade, dedup, publish
from jobstrata.plans import catalogue

from .test_advice import clusters


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_years_that_are_demanded(spark):
    texts = ["5+ yrs of it", "over 3 yrs", "5 + years", "2 or 3 years", "2-3 years", "minimum of 7 years, 4 years of relevant experience", "founded 30 years ago", "at least 45 years", "", None]
    assert values(spark, lambda c: nm.experience_floor(tx.fold(c)), *texts) == [5, 3, 5, 2, 2, 4, None, None, None, None]


def test_names_that_mean_one_firm(spark):
    pairs = [("Alder Labs AB", "Alder Labs Ltd"), ("Global Trading", "Global Partners"), ("Meridian SA", "Meridian Labs"), ("Ap4 Fund", "Ap4"), ("AB Northern Light", "Northern Light"), ("First Alpine", "First Alpine Bank"), ("", "x"), (None, "Alder")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(nm.same_firm(F.col("a"), F.col("b"), F.get(nm.identity_tokens(F.col("a")), F.lit(0)).isin("global", "first"))).collect()] == [True, False, True, False, True, True, False, False]


def test_names_as_headings(spark):
    assert values(spark, nm.readable, "ALPINE RIVER GMBH & CO. KG", "Insurance Company of AB", "mcAlder Ltd.", "north", "AB") == ["Alpine River", "Insurance Company", "mcAlder", "North", "Ab"]


def test_dates_on_boards(spark):
    df = spark.createDataFrame([(v,) for v in ("just posted", "2 months ago", "30+ days ago", "3 days ago", "2024-13-45", "yesterday", "1700000000000", None)], "v string")
    seen, observed = F.lit("2024-05-01").cast("date"), F.lit("2024-05-10").cast("date")
    got = [(str(r["p"]["date"]), r["p"]["precision"]) for r in df.select(nm.posted_date(F.col("v"), seen, observed).alias("p")).collect()]
    assert got == [("2024-05-10", "exact"), ("2024-03-11", "atleast"), ("2024-04-10", "atleast"), ("2024-05-07", "approx"), ("2024-05-01", "seen"), ("2024-05-09", "exact"), ("2023-11-14", "exact"), ("2024-05-01", "seen")]


def test_rules_hold_in_order_and_say_why(spark):
    ladder = cascade.Ladder("c", (cascade.Rule("a", (cascade.Has("t", ("x y", "z")), cascade.Has("t", ("no",), absent=True))), cascade.Rule("b", (cascade.Has("t", ("z",)),))))
    many = cascade.Several("m", (cascade.Rule("p", (cascade.Has("t", ("z",)),)), cascade.Rule("q", (cascade.Said("c", ("a",)),)), cascade.Rule("p", (cascade.Has("t", ("y",)),))))
    rows = spark.createDataFrame([(1, " z x y "), (2, " no z "), (3, " xy zz "), (4, None), (5, " x y ")], "id long, t string")
    out = cascade.decided(rows, (ladder, many))
    assert [(r["c"], r["c_evidence"], r["m"]) for r in out.orderBy("id").collect()] == [("a", "x y", ["p", "q"]), ("b", "z", ["p"]), ("unknown", None, []), ("unknown", None, []), ("a", "x y", ["q", "p"])]
    said = {(r["id"], r["dimension"], r["value"]) for r in cascade.tags(out, ["id"], (ladder, many), F.lit("weak")).collect()}
    assert said == {(1, "c", "a"), (1, "m", "p"), (1, "m", "q"), (2, "c", "b"), (2, "m", "p"), (3, "c", "unknown"), (3, "m", "unknown"), (4, "c", "unknown"), (4, "m", "unknown"), (5, "c", "a"), (5, "m", "q"), (5, "m", "p")}


@pytest.mark.parametrize(("limit", "n_boards"), [(10, 3), (40, 90), (100, 30), (500, 400)])
def test_draws_share_the_cap_and_hand_on_what_is_short(spark, limit, n_boards):
    rows = [(i, "ABC"[(i * i + i // 7) % 3] if i % 11 else "A", (i * 37) % n_boards if i % 50 else None) for i in range(700)]
    shares = {"B": 0.35, "A": 0.35, "C": 0.3, "none": 0.0}
    draw = lambda parts: {tuple(r) for r in boards.fair_draw(spark.createDataFrame(rows, "id long, s string, board long").repartition(parts), "s", ["board"], [F.md5(F.col("id").cast("string")), F.col("id")], shares, limit).collect()}
    got = draw(3)
    assert got == draw(5) and got <= set(rows)
    per_board, per_bucket = Counter(r[2] for r in got), Counter(r[1] for r in got)
    assert max(per_board.values()) <= 2 and len(got) <= limit
    free = [r for r in rows if r not in got and per_board[r[2]] < 2]
    assert len(got) == limit or not free  # nothing is missing that fits
    for bucket, share in shares.items():  # a bucket lacks some of its share only if its boards are full
        assert per_bucket[bucket] >= round(limit * share) or not [r for r in free if r[1] == bucket]
    order = lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])
    for r in got:  # of one board and bucket the first by order come first
        assert not [o for o in rows if o[1:] == r[1:] and order(o) < order(r) and o not in got]


def test_draws_of_plenty_keep_the_quotas(spark):
    rows = [(i, "ABC"[i % 3], i) for i in range(300)] + [(900, "D", 1), (901, None, 2)]
    df = spark.createDataFrame(rows, "id long, s string, board long")
    draw = lambda shares, limit: Counter(r["s"] for r in boards.fair_draw(df, "s", ["board"], [F.col("id")], shares, limit).collect())
    assert draw({"B": 0.35, "A": 0.35, "C": 0.3}, 100) == {"B": 35, "A": 35, "C": 30}
    assert draw({"D": 0.5, "C": 0.5}, 20) == {"D": 1, "C": 19} and draw({"D": 1.0}, 0) == {} and draw({"none": 1.0}, 5) == {}


def same(a, b, shared=()):
    a, b = ([w for w in x.lower().split() if len(w) > 1 and w not in tx.LEGAL] for x in (a, b))
    return bool(len(a) > 1 and a[:2] == b[:2] or a and b and a[0] == b[0] and len(a[0]) >= 5 and a[0] not in shared)


def shared_heads(names, most):
    own = {tuple(w for w in x.lower().split() if len(w) > 1 and w not in tx.LEGAL) for x in names if x}
    return {w for w, n in Counter(t[0] for t in own if t).items() if n > most}


def test_stacks_are_complete_links(spark):
    names = ["Northern Light AB", "Northern", "Northern Star", "Global Group", "Global Labs", "Alder", "Alder River Ltd", "Ap4", None]
    rows = [(i, f"f{i % 13}", names[(i * 5 + i // 13) % len(names)], "title" if i % 4 else "other", "place" if i % 9 else "") for i in range(120)]
    rows += [(500, None, "Alder", "title", "place"), (501, "f1", "Alder", None, "place")]
    want, shared = {}, shared_heads([r[2] for r in rows], 1)
    assert shared == {"northern", "global", "alder"}
    for group in {(r[3], r[4]) for r in rows}:
        stacks = []
        for r in sorted(x for x in rows if (x[3], x[4]) == group and x[1] is not None):
            if not (r[3] and r[4]):
                continue
            for s in stacks:
                if all(r[1] == o[1] or same(r[2] or "", o[2] or "", shared) for o in s):
                    s.append(r)
                    break
            else:
                stacks.append([r])
        for s in stacks:
            want |= {r[0]: min(x[0] for x in s) if len(s) > 1 else None for r in s}
    df = spark.createDataFrame(rows, "id long, firm string, name string, title string, place string").repartition(3)
    got = {r["id"]: r["similar"] for r in dedup.stacks(df, "title", "place", common=1).collect()}
    assert got == {r[0]: want.get(r[0]) for r in rows}


def test_cards_of_several_portals_fold(spark):
    firms = ["Northern Light", "Northern Star AB", "Northern Light Ltd", "Global One", "Global Two", "Meridian", "Ap4"]
    rows = [(i, "t" if i % 5 else None, f"p{i % 3}", [str(i % 4), str(i % 2)], firms[(i * 3 + i // 9) % len(firms)], float((i * 7) % 50)) for i in range(80)]
    rows += [(200, "t", "p0", [], "Northern Light", 0.0), (201, "t", "p0", ["0"], None, 0.0)]
    pairs = [(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] and a[1] == b[1] and a[2] != b[2] and set(a[3]) & set(b[3]) and a[4] and b[4] and same(a[4], b[4], {"northern", "global"})]
    root = clusters([r[0] for r in rows], pairs)
    want = {}
    for r in rows:
        best = want.setdefault(root[r[0]], [(r[5], r[0]), 0])
        best[0], best[1] = min(best[0], (r[5], r[0])), best[1] + 1
    df = spark.createDataFrame(rows, "id long, title string, portal string, hubs array<string>, firm string, price double").repartition(3)
    got = {(r["id"], r["members"]) for r in dedup.across(df, "title", [F.col("price"), F.col("id")], common=1).collect()}
    assert got == {(best[1], n) for best, n in want.values()}


def test_what_is_not_fit_is_not_published(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).toDF("id")
    publish.publish(df, root, stamp="a")
    for bad in ({"floor": 11}, {"stamp": "b"}, {"share": 1.2}):
        with pytest.raises(publish.Refused):
            publish.publish(df, root, **bad)
    assert publish.current(spark, root).count() == 10
    before = publish.current(spark, root)
    publish.publish(df.where("id < 5"), root, stamp="a")
    assert publish.current(spark, root).count() == 5 and before.count() == 10
    sheet = df.withColumn("label", F.when(F.col("id") < 3, "x"))
    kept = publish.redrawn(sheet, df.where("id > 7"), df, ["id"], "label IS NOT NULL")
    assert sorted((r["id"], r["label"]) for r in kept.collect()) == [(0, "x"), (1, "x"), (2, "x"), (8, None), (9, None)]
    with pytest.raises(publish.Refused):
        publish.redrawn(sheet, df, df.where("id > 1"), ["id"], "label IS NOT NULL")


def test_queries_without_sql_have_rows(spark, sf):
    for name in ("srt_fair", "dup_across", "dup_stacks"):
        assert catalogue.queries()[name](spark, sf).count() > 50


def test_common_first_words_are_counted(spark):
    names = ["Global One", "Global Two AB", "GLOBAL two", "Global Three", "Alder Labs", "Alder", "", None, "AB"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [[r["word"] for r in nm.shared_heads(df, "n", k).orderBy("word").collect()] for k in (1, 2, 3)] == [["alder", "global"], ["global"], []]


def test_statements_of_work(spark):
    verbs = ("answer", "build", "deploy")
    texts = ["We answer tickets for clients. You build models; deploy them!", "<p>Who we are: we build cranes.</p><b>Your tasks:</b><li>answer tickets</li><li>nothing</li><b>Requirements</b>build things", "Tasks\nbuild a\nAbout us\nwe build b\nDuties\ndeploy c", "", None, "Our firm builds. The team will build"]
    assert values(spark, lambda c: nm.duties(c, verbs), *texts) == [["you build models", "deploy them"], ["answer tickets"], ["build a", "deploy c"], [], None, []]


def test_what_scripts_escape(spark):
    texts = ["https:\\u002F\\u002fa\\/b", 'x="1" &amp;lt; &#65;&#x1F600;&#0;', "bad \\q stays", "", None, "a\nb", "&quot;q&quot;"]
    assert values(spark, nm.unescaped, *texts) == ["https://a/b", 'x="1" &lt; A\U0001f600', "bad \\q stays", "", None, "a\nb", '"q"']


def test_labels_and_needles_go_from_the_specific(spark):
    names = ["Global Alder Labs AB", "Global Pine", "Global Oak", "Pine", "X", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    own = nm.counted_tokens(df, "i", "n").orderBy("i")
    labels = [r[0] for r in own.select(nm.domain_labels(F.col("words"), F.col("own"))).collect()]
    assert labels[:4] == [["globalalderlabs", "globalalder", "global-alder", "alderlabs", "alder-labs"], ["globalpine", "global-pine", "pine", "global"], ["globaloak", "global-oak", "global"], ["pine"]] and labels[4] == []
    told = [[(x["needle"], x["strength"]) for x in r[0] or []] for r in own.select(nm.needles(F.col("words"), F.col("own"))).collect()]
    assert told[0] == [("global alder labs ab", "strong"), ("global alder labs", "strong"), ("alder", "weak")] and told[3] == [("pine", "strong")]


def test_titles_for_students_and_places(spark):
    titles = ["Student Data Engineer", "Data Engineer - student", "Data Engineer - student services", "Summer internship", "Internal auditor", "", None]
    assert values(spark, lambda c: nm.student_title(tx.fold(c)), *titles) == [True, True, False, True, False, False, False]
    places = ["Singapore D07 Bugis", "Stockholm", "12 Main Street", "Paris 8e", "Geneva GE"]
    assert values(spark, lambda c: nm.place_key(c, {"geneva ge": "geneve"}), *places) == ["singapore", "stockholm", "12 main street", "paris", "geneve"]
