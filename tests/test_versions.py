"""Versions of rules: digests, what depends on what, tags made anew for what changed alone."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from jobstrata.operators import cascade, posting_rules, versions
from jobstrata.operators.cascade import Has, Holds, Ladder, Rule, Said, Several

A = Ladder("a", (Rule("x", (Has("t", ("one", "two")),)), Rule("y", (Has("t", ("three",)),))))
B = Several("b", (Rule("p", (Said("a", ("x",)),)), Rule("q", (Has("t", ("four",)),))))
C = Ladder("c", (Rule("z", (Holds("a = 'y' AND t <> 'b'"),)),), None)
D = Ladder("d", (Rule("w", (Said("c", ("z",)), Has("t", ("three",)))),))
STEPS = (A, B, C, D)


def test_a_change_reaches_those_that_ask():
    assert versions.asks(STEPS) == {"a": (), "b": ("a",), "c": ("a",), "d": ("c",)}
    before = versions.digests(STEPS)
    for k, changed in ((0, {"a", "b", "c", "d"}), (1, {"b"}), (2, {"c", "d"}), (3, {"d"})):
        new = list(STEPS)
        new[k] = replace(new[k], rules=tuple(reversed((*new[k].rules, Rule("n", (Has("t", ("nine",)),))))))
        after = versions.digests(new)
        assert {n for n in after if after[n] != before[n]} == changed == set(versions.affected(STEPS, {STEPS[k].name}))
    assert versions.digests(STEPS) == before and versions.digests(STEPS, {"c": "fold 2"})["d"] != before["d"]


def test_drift_without_a_version_is_refused():
    first = versions.released(STEPS, {}, {})
    new = (*STEPS[:3], replace(D, default="none"))
    assert versions.released(STEPS, {}, first) == first
    with pytest.raises(versions.Drift):
        versions.released(new, {}, first)
    second = versions.released(new, {"d": 2}, first)
    assert second["a"] == first["a"] and second["d"][0] == 2
    with pytest.raises(versions.Drift):
        versions.released(STEPS, {"d": 1}, second)


def test_only_what_changed_is_made_anew(spark):
    names = [s.name for s in STEPS]
    rows = spark.createDataFrame([(i, f" {w} ") for i, w in enumerate(["one", "two four", "three", "three four", "none", "one three"])], "id long, t string")
    weak = F.lit("weak")
    old = versions.stamped(cascade.decided(rows.where("id < 5"), STEPS), ["id"], STEPS, weak)
    gone = versions.stamped(cascade.decided(spark.createDataFrame([(99, " one ")], "id long, t string"), STEPS), ["id"], STEPS, weak)
    new = (A, B, replace(C, rules=(Rule("z2", C.rules[0].given),)), D)
    marked = old.unionByName(gone).withColumn("evidence", F.coalesce("evidence", F.lit("kept")))
    got, stale = versions.retagged(rows, marked, ["id"], new, names, weak)
    assert stale == ("c", "d")
    told = {(r["id"], r["dimension"], r["value"], r["stamp"]) for r in got.collect()}
    want = versions.stamped(cascade.decided(rows, new), ["id"], new, weak)
    assert told == {(r["id"], r["dimension"], r["value"], r["stamp"]) for r in want.collect()} and len(told) == got.count()
    # tags of the other dimensions are those that were there
    assert {r["dimension"] for r in got.where("evidence = 'kept'").collect()} == {"a", "b"}
    again, stale = versions.retagged(rows, got, ["id"], new, names, weak)
    assert stale == () and again.count() == got.count()


def test_the_posting_rules_have_a_graph():
    graph = versions.asks((*posting_rules.FIRST, *posting_rules.LAST))
    assert "scope" in graph["reason"] and "different_field" in graph["reason"] and graph["scope"] == ()
