"""Queries over captured payloads: pages with jobs in them, made from the driver's pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import pages as pg
from ..sources import registry
from .catalogue import query, table
from .postings import pick

_VENDORS = (("alpha", r"boards[.]alpha[.]example/([A-Za-z0-9_-]+)"), ("beta", r"([a-z0-9-]+)[.]beta[.]example"))
_UNUSABLE = ("www", "assets")
_EXTRA = pick("page_id", '<a href="https://boards.alpha.example/Acme">Open jobs</a>', '<a href="https://www.beta.example/x">About</a><a href="/careers">Careers</a>', '<a href="https://boards.alpha.example/assets/">x</a><a href="https://firm.beta.example/jobs">Jobs</a>', '<a href="https://social.example/acme">We hire: jobs</a>', '<a href="team.html">Careers here</a><a href="/jobs#top">Jobs</a><a href="https://hr.example/jobs">More</a><a href="https://z.example/career">Z</a><a href="https://y.example/career">Y</a>')
_ANCHORS = r"""list_zip(regexp_extract_all(m, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)[^>]*>(.*?)</a>', 1), regexp_extract_all(m, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)[^>]*>(.*?)</a>', 2))"""
_HOST = "regexp_replace(regexp_extract({}, '^https?://([^/?#:]+)', 1), '^www[.]', '')"


@query(rf"""WITH p AS (SELECT page_id, 'https://www.acme.example/home' AS url, {_EXTRA} AS m FROM pages), z AS (SELECT *, {_ANCHORS} AS a FROM p),
u AS (SELECT page_id, url, m, list_transform(a, lambda x: struct_pack(u := CASE WHEN regexp_matches(x[1], '^[a-z]+://') THEN x[1] ELSE 'https://www.acme.example' || CASE WHEN starts_with(x[1], '/') THEN '' ELSE '/' END || x[1] END, t := lower(x[1] || ' ' || x[2]))) AS l FROM z),
f AS (SELECT page_id, m, list_transform(list_sort(list_distinct(list_transform(list_filter(l, lambda x: regexp_matches(x.t, 'career|jobs') AND {_HOST.format('x.u')} <> 'social.example'), lambda x: struct_pack(own := {_HOST.format('x.u')} = 'acme.example', u := x.u)))), lambda x: x.u)[1:3] AS c FROM u),
t AS (SELECT page_id, c, list_filter(list_transform(regexp_extract_all(m, 'boards[.]alpha[.]example/([A-Za-z0-9_-]+)', 1), lambda x: lower(x)), lambda x: x NOT IN ('www', 'assets'))[1] AS a, list_filter(regexp_extract_all(m, '([a-z0-9-]+)[.]beta[.]example', 1), lambda x: x NOT IN ('www', 'assets'))[1] AS b FROM f)
SELECT page_id, array_to_string(c, '|') AS careers, CASE WHEN a IS NOT NULL THEN 'alpha' WHEN b IS NOT NULL THEN 'beta' END AS vendor, coalesce(a, b) AS token, CASE WHEN coalesce(a, b) IS NOT NULL THEN 'A' WHEN len(c) > 0 THEN 'B' ELSE 'C' END AS tier FROM t""")
def src_boards(spark, sf_dir):
    """SRC-12 to 14: links that may lead to jobs, the vendor's board behind a page, and the tier of the firm."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_EXTRA).alias("m"))
    careers = pg.careers_links(F.col("m"), F.lit("https://www.acme.example/home"), ("career", "jobs"), ("social.example",))
    found = rows.select("page_id", careers.alias("c"), pg.fingerprint(F.col("m"), _VENDORS, _UNUSABLE).alias("f"))
    return found.select("page_id", F.array_join("c", "|").alias("careers"), F.col("f.vendor").alias("vendor"), F.col("f.token").alias("token"), pg.tier(F.col("f"), F.col("c")).alias("tier"))


def _payload(rows, name):
    item = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("Post "), "o_orderpriority")).alias("title"), F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string")).alias("absolute_url"), F.struct(F.col("o_orderstatus").alias("name")).alias("location")))
    one = rows.groupBy(F.concat(F.lit("b"), (F.col("o_custkey") % 50).cast("string")).alias("token")).agg(F.concat_ws(",", F.collect_list(item)).alias("l"))
    return one.select("token", F.concat(F.lit('{"jobs":['), "l", F.lit("]}")).alias("body"))


@query("SELECT concat('b', o_custkey % 50) AS token, CAST(o_orderkey AS VARCHAR) AS job_id, 'Post ' || o_orderpriority AS title, o_orderstatus AS location FROM orders WHERE o_orderkey % 7 <> 0")
def src_registry(spark, sf_dir):
    """BRD, UDF-02, PRJ-04: captured JSON boards read by their registered reader; items without a title are left out."""
    return registry.read("greenhouse", _payload(table(spark, sf_dir, "orders"), "greenhouse")).select("token", "job_id", "title", "location")


@query("SELECT o_orderkey, 'Post ' || o_orderpriority AS title, '/p/' || o_orderkey AS url FROM orders")
def src_segments(spark, sf_dir):
    """SIT, BDY: postings in segments of captured pages, by heading and link."""
    key = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("<div><h3 class='x'>Post <b>"), "o_orderpriority", F.lit("</b></h3><p>text</p><a class='l' href='/p/"), key, F.lit("'>more</a></div>"))
    rows = registry.read("segments", table(spark, sf_dir, "orders").select(key.alias("token"), body.alias("body")))
    return rows.select(F.col("token").cast("long").alias("o_orderkey"), "title", "url")


@query("WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders), f AS (SELECT * FROM r WHERE k = 1), n AS (SELECT o_orderstatus, count(*) AS n FROM f GROUP BY 1) SELECT f.o_custkey, f.o_orderstatus, f.o_orderkey, n.n >= CASE f.o_orderstatus WHEN 'P' THEN 10 WHEN 'O' THEN 60 ELSE 1 END AS sound FROM f JOIN n USING (o_orderstatus)")
def src_register(spark, sf_dir):
    """REG: a firm counts in the category read first; a category with fewer rows than ever before is unsound."""
    rows = registry.first_category(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", {"P": 0, "O": 1})
    counts = registry.floored(rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), {"P": 10, "O": 60}, "o_orderstatus")
    return rows.join(F.broadcast(counts.drop("n")), "o_orderstatus").select("o_custkey", "o_orderstatus", "o_orderkey", "sound")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'Bergen, NO' WHEN 2 THEN 'Remote' END AS place FROM events")
def jsn_place(spark, sf_dir):
    """JSN-03: places as boards write them in JSON."""
    value = F.expr(pick("event_id", '{"location":{"name":"Oslo"}}', '{"location":[{"city":"Bergen","country":"NO"}]}', '{"location":" Remote "}', '{"title":"x"}'))
    return table(spark, sf_dir, "events").select("event_id", pg.json_place(value).alias("place"))


@query("SELECT page_id, '{\"a\":[' || page_id || ',\"é\"]}' AS json FROM pages WHERE page_id % 3 <> 1")
def jsn_islands(spark, sf_dir):
    """JSN-02: the JSON value after a marker in a script, broken ones skipped."""
    key = F.col("page_id").cast("string")
    good = F.concat(F.lit("<script>var STATE = {\"a\": ["), key, F.lit(', "é"]};</script>'))
    html = F.when(F.col("page_id") % 3 == 1, F.lit("<script>STATE = {broken</script>")).otherwise(good)
    return pg.islands_after(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "STATE")
