"""Operators on literal rows: rules, ties, nulls, empty tables, order and number of partitions."""

import io
import json
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from jobstrata.functions import phrases
from jobstrata.functions import text as tx
from jobstrata.operators import classify, dedup, identity, merge, monitor, sampling, search
from jobstrata.sources import pages, sheets
from jobstrata.streaming import feeds


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("Große <b>Straße</b>", " grosse strasse "), ("C++ / C#", " cplusplus csharp "), ("Crème brûlée", " creme brulee "), ("  ", "  "), ("A.B-c", " a b c ")],
)
def test_fold(spark, given, want):
    assert one(spark, tx.fold(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("Acme Holding S.A. Ltd.", "acme holding"), ("North-Sea AB", "north sea"), ("AB", "ab"), ("Foo & Bar GmbH Co", "foo bar")])
def test_normal_name(spark, given, want):
    assert one(spark, tx.normal_name(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("http//www.Foo.com/x", "foo.com"), ("https://u:p@a.b.org:8080?q", "a.b.org"), ("localhost", None), (None, None)])
def test_host(spark, given, want):
    assert one(spark, tx.host(F.col("t")), t=given) == want


@pytest.mark.parametrize(("a", "b", "want"), [("Jane Street Capital", "Jane Street Group", True), ("Nordea Bank", "Nordea", True), ("Bank One", "Bank Two", False), ("", "x", False), (None, "x", False)])
def test_same_company(spark, a, b, want):
    assert one(spark, tx.same_company(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("given", "want"), [("5+ years, minimum 3", 3), ("between 4 to 7 years", 4), ("90 years", None), ("none", None)])
def test_years(spark, given, want):
    assert one(spark, tx.years_demanded(F.col("t")), t=given) == want


def test_compound_needs_a_margin(spark):
    heads = ("ingenieur",)
    assert one(spark, tx.compound(F.col("t"), heads), t=" der softwareingenieur ist ") == "softwareingenieur"
    assert one(spark, tx.compound(F.col("t"), heads), t=" der ingenieur ") is None


def test_chapman_is_refused_when_few_are_seen_twice(spark):
    df = spark.createDataFrame([(36, 2, 0), (50, 50, 50)], "a long, b long, m long")
    assert [r[0] for r in df.select(tx.chapman(F.col("a"), F.col("b"), F.col("m"))).collect()] == [None, 50]


def test_phrases_match_whole_tokens_only(spark):
    terms = phrases.vocabulary(spark, {"d": {"first": ["data science"], "second": ["data", "c"]}})
    texts = spark.createDataFrame([(1, " big data science "), (2, " database c "), (3, "  ")], "id long, f string")
    found = phrases.hits(texts, ["id"], "f", terms)
    assert {(r["id"], r["value"], r["evidence"]) for r in phrases.first_rung(found, ["id"]).collect()} == {(1, "first", "data science"), (2, "second", "c")}
    assert {(r["id"], r["phrases"]) for r in phrases.every_phrase(found, ["id"]).collect()} == {(1, "data science|data"), (2, "c")}


def test_unknown_is_explicit_and_version_follows_the_vocabulary(spark):
    terms = phrases.vocabulary(spark, classify.VOCABULARY)
    rows = spark.createDataFrame([(1, "zzz"), (2, None)], "id long, text string")
    tags = classify.tagged(rows, terms, ["id"], "text", list(classify.VOCABULARY)).collect()
    assert {(r["id"], r["dimension"], r["value"]) for r in tags} == {(i, d, "unknown") for i in (1, 2) for d in classify.VOCABULARY}
    assert classify.version() != classify.version({"x": {"y": ["z"]}})


def test_upsert_rules(spark):
    schema = "id long, title string, employer string, location string"
    old = spark.createDataFrame([(1, "a", "e", "Oslo"), (2, "b", None, "2 Locations")], schema)
    new = spark.createDataFrame([(1, "A", None, "3 Locations"), (2, None, "f", "Rome"), (3, "c", None, None)], schema)
    got = {r["id"]: tuple(r)[1:] for r in merge.upsert(old, new, ["id"], {"title": "new", "employer": "coalesce", "location": tx.resolved_place}).collect()}
    assert got == {1: ("A", "e", "Oslo"), 2: (None, "f", "Rome"), 3: ("c", None, None)}
    again = merge.upsert(merge.upsert(old, new, ["id"], {"title": "new", "employer": "coalesce"}), new, ["id"], {"title": "new", "employer": "coalesce"})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merge.upsert(old, new, ["id"], {"title": "new", "employer": "coalesce"}).collect()))


def test_changed_compares_nulls(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id long, t string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "y"), (4, "z")], "id long, t string")
    assert [r["id"] for r in merge.changed(old, new, ["id"], ["t"]).collect()] == [2]


@pytest.mark.parametrize("parts", [1, 7])
def test_components_of_a_chain_and_a_star(spark, parts):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)]
    got = identity.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(31)} | {(100 + i, 100) for i in range(40)}


def test_components_of_nothing(spark):
    assert identity.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_entities_are_named_by_the_strongest_key(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    keys = spark.createDataFrame([(1, 3, "name:x"), (2, 3, "name:x"), (2, 1, "lei:9"), (3, 2, "d.com")], "id long, kind_rank int, key string")
    assert {(r["id"], r["entity"]) for r in identity.resolved(rows, keys).collect()} == {(1, "lei:9"), (2, "lei:9"), (3, "d.com"), (4, "4")}


def test_gates_count_the_first_that_holds(spark):
    rows = spark.createDataFrame([(1, None), (5, "x"), (9, "x")], "n long, t string")
    got = search.gate_counts(search.gated(rows, [("big", F.col("n") > 4), ("x", F.col("t") == "x")]))
    assert {(r["gate"], r["n"]) for r in got.collect()} == {("big", 2), ("kept", 1)}


def test_failures_accumulate_and_postings_survive(spark):
    polls = spark.createDataFrame([("b", 1, 1, True, 7), ("b", 2, 2, False, None), ("b", 3, 3, False, None), ("c", 4, 1, False, None)], "board string, poll_id long, polled_at long, ok boolean, postings long")
    got = {r["board"]: (r["failures"], r["postings"], r["last_ok"]) for r in monitor.health(polls, ["board"], [F.col("polled_at"), F.col("poll_id")]).collect()}
    assert got == {"b": (2, 7, 1), "c": (1, None, None)}


def test_alerts(spark):
    runs = [("a", 1, 100, True), ("a", 2, 100, True), ("a", 3, 60, True), ("b", 1, 10, True), ("b", 2, 0, True), ("c", 1, 10, True), ("c", 2, 9, False), ("d", 1, 100, True), ("d", 2, 100, True), ("d", 3, 60, True)]
    df = spark.createDataFrame([(s, t, i, n, ok) for i, (s, t, n, ok) in enumerate(runs)], "source string, started_at long, id long, row_count long, ok boolean")
    assert {(r["source"], r["kind"]) for r in monitor.alerts(df, deltas=("d",)).collect()} == {("a", "shrank"), ("b", "empty"), ("c", "fail")}


def test_spread_keeps_first_and_last(spark):
    rows = spark.createDataFrame([(1, i) for i in range(11)] + [(2, i) for i in range(2)], "g long, i long")
    got = [(r["g"], r["i"]) for r in sampling.spread(rows, ["g"], [F.col("i")], 3).orderBy("g", "i").collect()]
    assert got == [(1, 0), (1, 5), (1, 10), (2, 0), (2, 1)]


@pytest.mark.parametrize("parts", [1, 5])
def test_sample_is_the_same_for_any_partitioning(spark, parts):
    rows = spark.range(500).withColumnRenamed("id", "k").repartition(parts)
    first = [r["k"] for r in sampling.uniform(rows, ["k"], 20).collect()]
    assert first == [r["k"] for r in sampling.uniform(rows.orderBy(F.desc("k")), ["k"], 20).collect()]


def test_without_a_fingerprint_nothing_folds(spark):
    cards = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, fp string")
    assert {(r["id"], r["dup"]) for r in dedup.collapsed(cards, "fp", [F.col("id")]).collect()} == {(1, 1), (3, 0), (4, 0)}


def test_near_equals_the_ratio(spark):
    a = "the quick brown fox jumps over the lazy dog " * 12
    texts = [a, a.replace("quick", "quiet"), a[: len(a) // 2], "z" * len(a)]
    cards = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "id long, k string, text string")
    want = {(i, j) for i in range(4) for j in range(i + 1, 4) if SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio() >= 0.93}
    assert {(r["a"], r["b"]) for r in dedup.near(cards, ["k"], "text").collect()} == want


def test_table_rows_and_links(spark):
    html = '<table><tr><th>A</th><td> b &amp; c </td></tr></table><a href="/x?q#f">1</a><a href="http://h.com/y">2</a><a href="http://o.com/z">3</a>'
    df = spark.createDataFrame([(1, html, "http://h.com/"), (2, None, None)], "page_id long, html string, url string")
    assert [tuple(r) for r in pages.table_rows(df).collect()] == [(1, 0, ["A", "b & c"])]
    assert df.select(pages.site_links(F.col("html"), F.col("url")).alias("l")).first()["l"] == ["/x", "/y"]


def test_json_ld_skips_broken_islands(spark):
    good = {"@graph": [{"@type": "JobPosting", "title": "T", "identifier": {"name": "n", "value": "7"}, "hiringOrganization": {"name": "F"}, "jobLocation": [{"address": {"addressLocality": "Oslo"}}]}]}
    html = f'<script type="application/ld+json">{{oops</script><script type="application/ld+json">{json.dumps(good)}</script>'
    got = pages.postings(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r["job_id"], r["title"], r["employer"], r["location"]) for r in got] == [("7", "T", "F", "Oslo")]


def test_feeds_sitemaps_and_payloads(spark):
    body = "<rss><item><title><![CDATA[A]]></title><link>http://h/1</link><guid>g1</guid></item></rss><entry><title>B</title><link href='http://h/2'/></entry>"
    got = pages.feed_items(spark.createDataFrame([(1, body)], "k long, body string"), "k").collect()
    assert [(r["job_id"], r["title"], r["url"]) for r in got] == [("g1", "A", "http://h/1"), ("http://h/2", "B", "http://h/2")]
    site = spark.createDataFrame([("http://h.com", "<loc>http://h.com/jobs/1</loc><loc>http://h.com/about</loc><loc>http://x.com/jobs/2</loc>")], "url string, body string")
    assert [r["loc"] for r in pages.sitemap(site).collect()] == ["http://h.com/jobs/1"]
    load = spark.createDataFrame([("t", '{"jobs": [{"id": 5, "text": "x"}]}')], "token string, body string")
    assert [tuple(r) for r in pages.payload_jobs(load, "jobs array<struct<id:long,text:string>>", "jobs", {"job_id": "cast(j.id as string)", "title": "j.text"}).collect()] == [("t", "5", "x")]


def test_xlsx_cells_stand_where_their_references_say(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    assert [r["cells"] for r in sheets.read_xlsx(spark, str(tmp_path)).orderBy("row").collect()] == [["head", None, "4"], [None, "in"]]


def test_roster_joins_what_overflows(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("oslo,focus,Foo,F|Fo,active,a, b, c",)], "value string")
    assert [tuple(r) for r in sheets.roster(lines).collect()] == [("oslo", "focus", "Foo", ["F", "Fo"], "active", "a, b, c")]


def test_streaming_state_equals_the_batch_form(spark, tmp_path):
    polls = [("b", 1, 1, True, 7), ("b", 2, 2, False, None), ("c", 3, 1, False, None), ("b", 4, 3, False, None)]
    schema = "board string, poll_id long, polled_at long, ok boolean, postings long"
    spark.createDataFrame(polls, schema).coalesce(1).write.json(f"{tmp_path}/in")
    feeds.failure_streaks(spark.readStream.schema(schema).json(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("streaks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    batch = monitor.health(spark.createDataFrame(polls, schema), ["board"], [F.col("polled_at"), F.col("poll_id")])
    assert {tuple(r) for r in spark.table("streaks").collect()} == {(r["board"], r["failures"], r["postings"]) for r in batch.collect()}
