"""Rosters against boards and portals: literal cases."""

from jobstrata.operators import roster


def told(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_names_of_any_length_are_found(spark):
    names = spark.createDataFrame([("ab",), ("x",), ("abc",), ("northern",), ("",), (None,), ("é!",)], "name string")
    texts = spark.createDataFrame([("cab fab",), ("northern labs",), ("x",), ("abc",), ("",), (None,), ("né!",)], "text string")
    want = sorted((n, t) for (n,) in names.collect() for (t,) in texts.collect() if n and t and n in t)
    assert told(roster.spelled(names, texts, "name", "text"), "name", "text") == want


def test_lines_say_who_is_reached(spark):
    lines = spark.createDataFrame([("oslo", "focus", "Alder", False), ("bergen", "focus", "Alder", False), ("oslo", "focus", "Pine", False), ("oslo", "focus", "Oak", False), ("oslo", "other", "Elm", False), ("oslo", "focus", "Gone", True), ("oslo", "focus", "New", False)], "hub string, priority string, name string, absent boolean")
    targets = spark.createDataFrame([("Alder", "alder.example", ["Alder AB"]), ("Pine", None, ["Pine Labs AS", "Pine"]), ("Oak", "oak.example", ["Oak"]), ("Elm", "elm.example", ["Elm"])], "label string, domain string, names array<string>")
    job = lambda domain, employer, portal, ats="p", token="p", removed=False: (domain, employer, portal, removed, ats, token)
    rows = [job("alder.example", None, False, "g", "alder")] * 2 + [job(None, "PINE group", True), job(None, "Spine", True), job(None, "Pine Labs", True, removed=True)]
    rows += [job("oak.example", "Oak", True), job(None, "Oak", True), job(None, None, False, "g", "e"), job("elm.example", None, False, "g", "old", True)]
    jobs = spark.createDataFrame(rows, "domain string, employer string, portal boolean, removed boolean, ats string, token string")
    solved = spark.createDataFrame([("elm.example", "A", "g", "none", False), ("alder.example", "A", "g", "e", False), ("oak.example", "A", "p", "p", True), ("oak.example", "B", "g", "e", False)], "domain string, tier string, ats string, token string, portal boolean")
    got = roster.followed(lines, targets, jobs, solved)
    want = [("bergen", "Alder", 2, 0, True, True, True, False), ("oslo", "Alder", 2, 0, True, True, True, False), ("oslo", "Elm", 0, 0, True, False, True, False), ("oslo", "New", 0, 0, False, False, False, False), ("oslo", "Oak", 0, 1, False, False, False, True), ("oslo", "Pine", 0, 2, False, False, False, True)]
    assert told(got, "hub", "name", "postings", "portal", "board", "polled", "reached", "portal_only") == want
    assert told(roster.hub_rates(got), "priority", "hub", "lines", "reached", "producing", "portal_only", "postings") == [("focus", "bergen", 1, 1, 1, 0, 2), ("focus", "oslo", 4, 1, 1, 2, 2), ("other", "oslo", 1, 1, 0, 0, 0)]
    assert roster.headline(got).first().asDict() == {"firms": 5, "reached": 2, "producing": 1, "portal_only": 2}
    assert told(roster.missing(got, "focus"), "name", "portal") == [("New", 0), ("Oak", 1), ("Pine", 2)]
