"""Captured payloads: identities of postings, walks over sitemaps, readers."""

import json

import pytest

from jobstrata.sources import pages, registry


def page(*islands):
    return "".join(f'<script type="application/ld+json">{json.dumps(x) if not isinstance(x, str) else x}</script>' for x in islands)


def test_a_posting_is_known_by_its_own_identifier(spark):
    job = {"@type": "JobPosting", "title": "T"}
    named = {"identifier": {"@type": "PropertyValue", "name": "Firm", "value": 8}}
    html = page({"@graph": [job | named, {"x": [{"deep": job | {"identifier": {"name": "Firm"}, "url": "/p/1"}}]}]}, [job | {"title": "Other "}, {"@type": ["Thing", "JobPosting"], "name": "Third", "identifier": "z"}], {"@type": "JobPosting", "identifier": "lost"}, "{broken")
    df = spark.createDataFrame([(1, "https://h.example/jobs", html), (2, None, page(job)), (3, "u", None)], "page_id long, url string, html string")
    got = [(r["page_id"], r["job_id"], r["title"]) for r in pages.postings(df, url="url").collect()]
    assert got == [(1, "8", "T"), (1, "https://h.example/p/1", "T"), (1, "https://h.example/jobs#other", "Other"), (1, "z", "Third"), (2, "#t", "T")]


def test_sitemaps_are_walked(spark):
    docs = [
        ("https://a.example/robots.txt", "User-agent: *\nSitemap: https://a.example/map.xml\nsitemap: https://a.example/flat.xml"),
        ("https://a.example/map.xml", "<sitemapindex><sitemap><loc>https://a.example/jobs.xml</loc></sitemap><sitemap><loc>https://b.example/jobs.xml</loc></sitemap></sitemapindex>"),
        ("https://a.example/jobs.xml", "<urlset><url><loc> https://a.example/jobs/1 </loc></url><url><loc>https://a.example/about</loc></url><url><loc>https://c.example/jobs/2</loc></url></urlset>"),
        ("https://a.example/flat.xml", "<urlset><url><loc>https://a.example/careers/3</loc></url></urlset>"),
        ("https://b.example/jobs.xml", "<urlset><url><loc>https://b.example/jobs/4</loc></url></urlset>"),
        ("https://a.example/unnamed.xml", "<urlset><url><loc>https://a.example/jobs/5</loc></url></urlset>"),
    ]
    df = spark.createDataFrame(docs, "url string, body string")
    assert sorted(r["loc"] for r in pages.sitemap_walk(df).collect()) == ["https://a.example/careers/3", "https://a.example/jobs/1"]


@pytest.mark.parametrize(
    ("name", "body", "want"),
    [
        ("lever", '[{"id":"1","text":"T","categories":{"location":"Oslo","team":"R"}},{"id":"2"}]', [("1", "T", "Oslo")]),
        ("lever_eu", '[{"id":"1","text":"T"}]', [("1", "T", None)]),
        ("lever", '{"jobs":[{"id":"1","text":"T"}]}', []),
        ("greenhouse", '{"jobs":[{"id":8,"title":"T","location":{"name":"Oslo"},"departments":[{"name":"A"},{"name":"B"}]}]}', [("8", "T", "Oslo")]),
        ("ashby", '{"jobs":[{"jobId":"x","title":"T","location":"Oslo"}]}', [("x", "T", "Oslo")]),
        ("recruitee", '{"offers":[{"id":3,"position":"T","city":"Oslo","country":"Norway"},{"id":4,"title":"U","location":"Bergen"}]}', [("3", "T", "Oslo, Norway"), ("4", "U", "Bergen")]),
        ("workable", '{"jobs":[{"shortcode":"s","title":"T","location":{"city":"Oslo","country":"Norway"}},{"id":5,"title":"U","location":"Bergen"},{"id":6,"title":"V","city":"Voss"}]}', [("s", "T", "Oslo, Norway"), ("5", "U", "Bergen"), ("6", "V", "Voss")]),
        ("bamboohr", '{"result":[{"id":"4","jobOpeningName":"T","location":{"city":"Oslo"}},{"id":"5","jobOpeningName":"U","atsLocation":"Bergen"}]}', [("4", "T", "Oslo"), ("5", "U", "Bergen")]),
        ("breezy", '[{"friendly_id":"f","name":"T","location":{"city":"Oslo","country":{"name":"Norway"}}},{"id":"g","name":"U","location":null}]', [("f", "T", "Oslo, Norway"), ("g", "U", None)]),
        ("personio", '[{"id":7,"name":"T","office":"Oslo"}]', [("7", "T", "Oslo")]),
        ("breezy", '[]', []),
        ("smartrecruiters", '{"content":[{"id":"9","name":"N","location":{"city":"Oslo","country":"no"}}]}', [("9", "N", "Oslo, NO")]),
        ("rss", "<rss><item><title>T</title><guid>g</guid></item><item><title></title></item></rss>", [("g", "T", None)]),
        ("jsonld", page({"@type": "JobPosting", "title": "T", "identifier": "7"}), [("7", "T", None)]),
        ("table", "<table><tr><td>T</td><td>Oslo</td></tr><tr><td></td></tr></table>", [("0", "T", "Oslo")]),
        ("greenhouse", "not json", []),
    ],
)
def test_readers(spark, name, body, want):
    df = spark.createDataFrame([("t", body), ("u", None)], "token string, body string")
    assert [(r["job_id"], r["title"], r["location"]) for r in registry.read(name, df).collect()] == want


def test_an_unreadable_payload_is_not_an_empty_board(spark):
    def told(name, *bodies):
        df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "token string, body string")
        return [(r["outcome"], r["n"]) for r in registry.outcomes(name, df).orderBy("token").collect()]

    bad, none = ("unreadable", None), ("empty", 0)
    assert told("lever", '[{"id":"1"}]', "[]", '{"jobs":[]}', "<html>gone</html>", None, "") == [("read", 1), none, bad, bad, bad, bad]
    assert told("greenhouse", '{"jobs":[]}', "[]", '{"jobs":null}', '{"jobs":[{},{}]}', '{"jobs":[') == [none, bad, bad, ("read", 2), bad]
    assert told("rss", "<rss><channel></channel></rss>", "<rss><item/></rss>", "not found") == [none, ("read", 1), bad]
    assert told("table", "<table><tr><td>T</td></tr></table>", "<html></html>", "503") == [("read", 1), none, bad]


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        registry.register("lever", registry.Reader("rss"))


def test_bodies_come_from_their_sources_function(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("a", "2")], "ats string, job_id string")
    got = registry.bodies(rows, spark.createDataFrame([("a", "1", "<p>x</p>"), ("b", "1", "y"), ("c", "1", "z")], "ats string, job_id string, page string"), {"a": lambda p: F.regexp_replace(p, "<[^>]*>", ""), "b": F.upper})
    assert {tuple(r) for r in got.collect()} == {("a", "1", "x"), ("b", "1", "Y"), ("c", "1", None), ("a", "2", None)}
