"""Queries of the board: what is still offered, queues, rosters, draws, sinks. Orders stand for postings, customers for firms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import text as tx
from ..operators import boards, dedup, publish
from ..operators.tables import new_path
from .catalogue import query, table
from .postings import pick

_ATS = pick("o_custkey", "portal", "vendor_a", "vendor_b", "vendor_c", "vendor_a")
_JOB = {
    "id": "o_orderkey",
    "ats": _ATS,
    "token": "concat('b', o_custkey % 37)",
    "removed_at": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END",
    "first_seen": "o_orderdate",
    "last_seen": "CAST(o_orderdate AS DATE)",
    "title": pick("o_orderkey", "Analyst", " ", "Engineer", None, "Scientist"),
    "body": "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END",
    "relevance": pick("o_orderkey + o_custkey", "relevant", "unknown", None, "rejected"),
    "lang": pick("o_orderkey", "en", "sv", "de", "unknown", "fr", "en"),
    "domain": "CASE WHEN o_orderkey % 5 <> 0 THEN " + pick("o_orderkey + o_custkey", "a.alpha.example", "alpha.org", "alphabeta.net", "b3.net", "careers.b5.com", "gamma.io") + " END",
    "firm": "o_custkey % 200",
}
JOBS = f"SELECT {', '.join(f'{e} AS {c}' for c, e in _JOB.items())} FROM orders"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in _JOB.items()])


# --- filters ---


@query(f"SELECT id FROM ({JOBS}) WHERE removed_at IS NULL AND first_seen >= TIMESTAMP '1996-01-01' AND coalesce(body, '') <> ''")
def flt_live(spark, sf_dir):
    """FLT-01, FLT-03, FLT-04: live postings first seen since a day, with a body."""
    return jobs(spark, sf_dir).where("removed_at IS NULL AND first_seen >= timestamp_ntz '1996-01-01' AND body <> ''").select("id")


@query(f"WITH j AS ({JOBS}), r AS (SELECT ats, token, max(last_seen) AS m FROM j GROUP BY ALL), l AS (SELECT DISTINCT ats, token FROM j WHERE firm % 3 <> 0) SELECT j.id, CASE WHEN j.ats <> 'portal' AND l.ats IS NULL THEN 'retired_board' WHEN j.ats <> 'portal' AND j.last_seen < r.m THEN 'withdrawn' END AS gone FROM j JOIN r USING (ats, token) LEFT JOIN l ON l.ats = j.ats AND l.token = j.token")
def flt_listed(spark, sf_dir):
    """FLT-08, AGG-10: postings that their board's last complete read lacks, and those of retired boards; never on feeds of changes."""
    j = jobs(spark, sf_dir)
    return boards.still_listed(j, j.where("firm % 3 <> 0"), ["ats", "token"], F.col("ats") != "portal").select("id", "gone")


@query(f"WITH j AS ({JOBS}) SELECT count(*) FILTER (coalesce(relevance, 'unknown') = 'unknown' AND ats = 'portal') AS unread, count(*) FILTER (relevance IS NULL) AS untagged, count(*) FILTER (trim(coalesce(title, '')) = '') AS untitled, count(*) FILTER (lang IN ('en', 'sv', 'unknown')) AS readable FROM j")
def flt_holdouts(spark, sf_dir):
    """FLT-10, FLT-11, FLT-12: cards of a census that nobody has read, postings without tags or titles, readable languages."""
    j = jobs(spark, sf_dir)
    unread = (F.coalesce("relevance", F.lit("unknown")) == "unknown") & F.col("ats").isin("portal")
    return j.agg(F.count_if(unread).alias("unread"), F.count_if(F.col("relevance").isNull()).alias("untagged"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("untitled"), F.count_if(F.col("lang").isin("en", "sv", "unknown")).alias("readable"))


_TOKEN = pick("s_suppkey", "acme|wd3|Careers", "assets-cdn", "jane-street", "__assets__", "12345", "careers|wd1|x", "", "www-acme", "jobs-2024")
_FURNITURE = ("assets", "careers", "cdn", "external", "jobs", "static")
_URL = pick("s_suppkey", "https://www.acme.example/careers", "https://jobs.acme.example/x", "https://notacme.example/", "https://boards.example.net/acme", "mailto:x")


@query(f"WITH a AS (SELECT s_suppkey, {_TOKEN} AS t, {_URL} AS u FROM supplier), b AS (SELECT *, list_filter(string_split_regex(lower(string_split(t, '|')[1]), '[-_]+'), lambda p: p <> '') AS p, regexp_replace(regexp_extract(u, '^https?://([^/]+)', 1), '^www[.]', '') AS h FROM a) SELECT s_suppkey, len(p) = 0 OR list_contains(p, 'www') OR len(list_filter(p, lambda x: x NOT IN ('{"', '".join(_FURNITURE)}') AND NOT regexp_matches(x, '^[0-9]+$'))) = 0 AS infrastructure, h = 'acme.example' OR ends_with(h, '.acme.example') AS own_site, t LIKE '%wd%' AND t NOT LIKE '%careers%' AS graded FROM b")
def flt_tokens(spark, sf_dir):
    """FLT-15, FLT-16, FLT-17: evidence by pattern, tokens that name a vendor's own host, careers pages on the firm's own site."""
    t = F.expr(_TOKEN)
    own = tx.on_platform(tx.host(F.expr(_URL)), ("acme.example",))
    return table(spark, sf_dir, "supplier").select("s_suppkey", nm.placeless_token(t, _FURNITURE).alias("infrastructure"), own.alias("own_site"), (t.like("%wd%") & ~t.like("%careers%")).alias("graded"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 = 0) <= 1 AS one_employer FROM orders GROUP BY ALL")
def flt_one_employer(spark, sf_dir):
    """FLT-18: pages that name one hiring organisation at most; postings without a name don't count."""
    name = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count_distinct(name) <= 1).alias("one_employer"))


# --- joins ---

_FIRMS = "SELECT c_custkey AS firm, c_nationkey AS country, CASE WHEN c_custkey % 3 <> 0 THEN concat('d', c_custkey % 40, '.example') END AS domain, c_mktsegment AS source, c_acctbal AS rows FROM customer"
_TIERS = "SELECT concat('d', s_suppkey % 40, '.example') AS domain, min(CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END) AS tier, min(CASE WHEN s_suppkey % 4 <> 1 THEN concat('t', s_suppkey) END) AS token FROM supplier GROUP BY 1"


def _firms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("firm"), F.col("c_nationkey").alias("country"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN concat('d', c_custkey % 40, '.example') END").alias("domain"), F.col("c_mktsegment").alias("source"), F.col("c_acctbal").alias("rows"))


def _tiers(spark, sf_dir):
    key = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), (key % 40).cast("string"), F.lit(".example")).alias("domain"), F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("C").alias("tier"), F.when(key % 4 != 1, F.concat(F.lit("t"), key.cast("string"))).alias("token"))
    return own.groupBy("domain").agg(F.min("tier").alias("tier"), F.min("token").alias("token"))


@query(f"WITH f AS ({_FIRMS}), t AS ({_TIERS}) SELECT f.firm, f.domain FROM f LEFT JOIN t USING (domain) WHERE f.domain IS NOT NULL AND coalesce(t.tier, 'C') <> 'A' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = f.firm AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = f.firm AND o_orderpriority = '1-URGENT')")
def jon_targets(spark, sf_dir):
    """JON-06: firms with a domain, no board of the first tier, never looked up before and without postings: inner, left and two anti joins."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "firm")
    left = _firms(spark, sf_dir).where("domain IS NOT NULL").join(_tiers(spark, sf_dir), "domain", "left").where(F.coalesce("tier", F.lit("C")) != "A")
    return left.join(o.where("o_orderstatus = 'P'"), "firm", "left_anti").join(o.where("o_orderpriority = '1-URGENT'"), "firm", "left_anti").select("firm", "domain")


@query(f"WITH f AS ({_FIRMS}), t AS ({_TIERS}) SELECT f.firm, f.domain IS NULL AS homeless FROM f LEFT JOIN t ON t.domain = f.domain WHERE t.domain IS NULL")
def jon_unresolved(spark, sf_dir):
    """JON-07: what a left join leaves without a partner."""
    f = _firms(spark, sf_dir)
    return f.join(_tiers(spark, sf_dir), "domain", "left_anti").select("firm", F.col("domain").isNull().alias("homeless"))


@query(f"WITH j AS ({JOBS}) SELECT id, 0 AS arm FROM j WHERE coalesce(body, '') = '' AND relevance = 'relevant' UNION ALL SELECT id, 1 FROM j LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) AS g ON g.c_custkey = j.firm WHERE coalesce(body, '') = '' AND g.c_custkey IS NULL AND relevance IS DISTINCT FROM 'relevant'")
def jon_queue(spark, sf_dir):
    """JON-09: the arms of a queue: rated postings without a body, and those whose firm passed no gate."""
    bare = jobs(spark, sf_dir).where("coalesce(body, '') = ''")
    gate = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("firm"))
    first = bare.where("relevance = 'relevant'").select("id", F.lit(0).alias("arm"))
    return first.unionByName(bare.where("NOT relevance <=> 'relevant'").join(gate, "firm", "left_anti").select("id", F.lit(1).alias("arm")))


@query(f"WITH t AS ({_TIERS}), w AS (SELECT concat('d', user_id % 40, '.example') AS domain, max(ts) AS watched FROM events WHERE event_type = 'view' GROUP BY 1), a AS (SELECT concat('d', user_id % 40, '.example') AS domain, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1) SELECT t.domain, w.watched, coalesce(a.attempts, 0) AS attempts FROM t LEFT JOIN w USING (domain) LEFT JOIN a USING (domain) WHERE tier = 'B'")
def jon_watch(spark, sf_dir):
    """JON-10: pages of the second tier with when they were seen last and how often they failed."""
    e = table(spark, sf_dir, "events").withColumn("domain", F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".example")))
    seen = e.where("event_type = 'view'").groupBy("domain").agg(F.max("ts").alias("watched"))
    failed = e.where("event_type = 'error'").groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"))
    return _tiers(spark, sf_dir).where("tier = 'B'").join(seen, "domain", "left").join(failed, "domain", "left").select("domain", "watched", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query(f"WITH f AS ({_FIRMS}), t AS ({_TIERS}) SELECT source, count(*) AS firms, count(f.domain) AS with_domain, count(*) FILTER (tier = 'A') AS boards, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = f.firm)) AS producing FROM f LEFT JOIN t USING (domain) GROUP BY source")
def jon_coverage(spark, sf_dir):
    """JON-11, JON-14, AGG-07 to 09: firms of each source with a domain, a board and postings."""
    some = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("firm")).distinct().withColumn("some", F.lit(True))
    both = _firms(spark, sf_dir).join(_tiers(spark, sf_dir), "domain", "left").join(some, "firm", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("firms"), F.count("domain").alias("with_domain"), F.count_if(F.col("tier") == "A").alias("boards"), F.count("some").alias("producing"))


@query("WITH r AS (SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:1 + p_partkey % 3], ' ') AS name FROM part) SELECT p_partkey, name FROM part JOIN r ON contains(' ' || p_name || ' ', ' ' || name || ' ') WHERE name <> ''")
def jon_runs(spark, sf_dir):
    """JON-12: names of one to three words that stand in others as runs of words."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    roster = part.select(F.array_join(F.slice(F.split("p_name", " "), F.lit(1), (1 + F.col("p_partkey") % 3).cast("int")), " ").alias("name")).where("name <> ''").distinct()
    return boards.contained_runs(part, "p_name", roster, "name").select("p_partkey", "name")


@query("WITH r AS (SELECT DISTINCT substr(p_name, 2, 4) AS name FROM part) SELECT p_partkey, name FROM part JOIN r ON contains(p_name, name) WHERE length(name) >= 3")
def jon_substring(spark, sf_dir):
    """JON-13: spellings that names contain anywhere."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    roster = part.select(F.substring("p_name", 2, 4).alias("name")).distinct()
    return boards.contained_strings(part, "p_name", roster, "name").select("p_partkey", "name")


@query(f"WITH t AS ({_TIERS}) SELECT domain, token FROM t WHERE tier = 'A' AND (token IS NULL OR substr(token, 1, 2) NOT IN ('t1', 't3', 't6'))")
def jon_unpollable(spark, sf_dir):
    """JON-17: boards of the first tier that no reader can poll."""
    return _tiers(spark, sf_dir).where((F.col("tier") == "A") & ~F.coalesce(F.substring("token", 1, 2).isin("t1", "t3", "t6"), F.lit(False))).select("domain", "token")


# --- aggregates ---


@query("SELECT count(*) FILTER (o_orderkey % 5 <> 3) AS stale, count(DISTINCT o_orderkey % 5) AS versions FROM orders")
def agg_versions(spark, sf_dir):
    """AGG-04, CLS-28: rows that another version than the current one wrote."""
    v = F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").agg(F.count_if(v != 3).alias("stale"), F.count_distinct(v).alias("versions"))


_LABEL = "CASE WHEN contains(domain, '.') THEN string_split(domain, '.')[-2] ELSE domain END"


@query(f"WITH j AS (SELECT ats || '-' || token AS board, domain FROM ({JOBS}) WHERE domain IS NOT NULL), c AS (SELECT board, domain, count(*) AS n, {_LABEL} AS label, len(list_filter(string_split_regex(board, '[|_-]+'), lambda p: p NOT IN ('careers', 'jobs') AND list_contains(string_split(domain, '.'), p))) > 0 AS named FROM j GROUP BY ALL), p AS (SELECT c.board, min(struct_pack(l := length(c.label), x := c.label, d := c.domain)).d AS parent FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.board = c.board AND NOT starts_with(o.label, c.label)) GROUP BY c.board) SELECT c.board, CASE WHEN count(*) FILTER (named) = 1 THEN max(domain) FILTER (named) ELSE coalesce(any_value(p.parent), arg_max(domain, (n, domain))) END AS domain FROM c LEFT JOIN p USING (board) GROUP BY c.board HAVING count(*) > 1")
def agg_board_domain(spark, sf_dir):
    """AGG-11: whose a board is: by its token, by the brand that the others extend, by most rows."""
    j = jobs(spark, sf_dir).select(F.concat_ws("-", "ats", "token").alias("board"), "domain")
    return boards.board_domains(j, "board", ("careers", "jobs"))


@query(f"WITH j AS ({JOBS}) SELECT token, count(*) FILTER (relevance = 'relevant') AS hits, count(*) AS n FROM j WHERE ats <> 'portal' GROUP BY token HAVING count(*) FILTER (relevance = 'relevant') >= 2 AND count(*) FILTER (relevance = 'relevant') >= 0.05 * count(*)")
def agg_quant_board(spark, sf_dir):
    """AGG-13, CLS-26: boards with two hits and a twentieth of all their rows, national feeds aside."""
    own = jobs(spark, sf_dir).where("ats <> 'portal'").groupBy("token").agg(F.count_if(F.col("relevance") == "relevant").alias("hits"), F.count(F.lit(1)).alias("n"))
    return own.where((F.col("hits") >= 2) & (F.col("hits") >= 0.05 * F.col("n")))


@query(f"WITH j AS ({JOBS}), c AS (SELECT firm, domain, count(*) AS n FROM j WHERE domain IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY ends_with(domain, '.net'), n DESC, length(domain), domain) AS k FROM c) SELECT firm, domain, n FROM r WHERE k = 1")
def agg_website(spark, sf_dir):
    """AGG-15, ENT-06: a firm's commonest site; those on platforms only where there is no other."""
    j = jobs(spark, sf_dir).where("domain IS NOT NULL")
    counts = j.groupBy("firm", "domain").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("firm").agg(F.min(F.struct(F.endswith("domain", F.lit(".net")).alias("p"), (-F.col("n")).alias("m"), F.length("domain").alias("l"), "domain", "n")).alias("b"))
    return best.select("firm", "b.domain", "b.n")


@query(f"WITH j AS ({JOBS}), c AS (SELECT token, firm, min(id) AS id, count(*) AS dup, arg_min(removed_at, id) FILTER (removed_at IS NOT NULL) AS due FROM j GROUP BY ALL) SELECT id, dup, due FROM c")
def agg_folded(spark, sf_dir):
    """AGG-23, SRT-13: the first card of a group with how many it stands for, and the first deadline that any of them has."""
    own = jobs(spark, sf_dir).groupBy("token", "firm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("dup"), F.min_by("removed_at", F.when(F.col("removed_at").isNotNull(), F.col("id"))).alias("due"))
    return own.select("id", "dup", "due")


@query(f"WITH f AS (SELECT f.*, t.tier FROM ({_FIRMS}) AS f LEFT JOIN ({_TIERS}) AS t USING (domain)), l AS (SELECT country, count(*) AS lines, count(domain) AS known, count(*) FILTER (tier = 'A') AS reached FROM f GROUP BY country), d AS (SELECT country, count(DISTINCT coalesce(domain, '~' || firm)) AS firms FROM f GROUP BY country) SELECT country, lines, known, reached, firms, reached / lines AS rate FROM l JOIN d USING (country)")
def agg_pipeline(spark, sf_dir):
    """AGG-26, ENT-07, ENT-08, EVL-12: lines of a roster by place: known, reached, and the number of different firms."""
    f = _firms(spark, sf_dir).join(_tiers(spark, sf_dir), "domain", "left")
    own = f.groupBy("country").agg(F.count(F.lit(1)).alias("lines"), F.count("domain").alias("known"), F.count_if(F.col("tier") == "A").alias("reached"), F.count_distinct(nm.firm_key(F.col("domain"), F.col("firm").cast("string"))).alias("firms"))
    return own.withColumn("rate", F.col("reached") / F.col("lines"))


@query("SELECT o_custkey % 20 AS g, map_from_entries(list_sort(list((p, n)))) AS groups FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM (SELECT o_custkey % 20 AS o_custkey, o_orderpriority FROM orders) GROUP BY ALL) GROUP BY ALL".replace("map_from_entries(list_sort(list((p, n))))", "array_to_string(list_sort(list(p || '=' || n)), ';')"))
def map_groups(spark, sf_dir):
    """MAP-01: counts by group as a map a row, here written out in the order of its keys."""
    counts = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("g"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))
    return m.select("g", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))), ";").alias("groups"))


# --- orders ---


@query("WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, sum(value) AS cost, max(value) AS took FROM events GROUP BY user_id) SELECT user_id, failures FROM p WHERE failures >= 1 ORDER BY cost DESC, took DESC, user_id LIMIT 50")
def srt_failing(spark, sf_dir):
    """SRT-06: failing boards by what they cost, then by how long they take."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("value").alias("cost"), F.max("value").alias("took"))
    return own.where("failures >= 1").orderBy(F.desc("cost"), F.desc("took"), "user_id").select("user_id", "failures").limit(50)


@query("SELECT o_orderkey FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderpriority DESC, o_orderkey LIMIT 300")
def srt_board(spark, sf_dir):
    """SRT-07: the board's base order, newest first, then by title."""
    return table(spark, sf_dir, "orders").orderBy(F.desc(F.to_date("o_orderdate")), F.desc("o_orderpriority"), "o_orderkey").select("o_orderkey").limit(300)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) > (1000, 2) ORDER BY l_orderkey, l_linenumber LIMIT 500")
def srt_keyset(spark, sf_dir):
    """SRT-08: the page of rows after a key, by comparison of rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return boards.pages_after(rows, ["l_orderkey", "l_linenumber"], (1000, 2), 500)


@query()
def srt_fair(spark, sf_dir):
    """SRT-10, WIN-05, EVL-13: a stratified draw of 100 with two rows a board over all strata and shortfalls handed on; tests hold it against a plain version."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return boards.fair_draw(o, "o_orderstatus", ["o_custkey"], [F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey")], {"P": 0.35, "F": 0.35, "O": 0.3}, 100)


# --- sinks ---

_OLD = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'hand' ELSE 'guess' END AS method, CASE WHEN s_suppkey % 7 = 0 THEN 'x.platform.example' ELSE concat('s', s_suppkey, '.example') END AS domain, CAST(s_suppkey % 3 AS INTEGER) AS grade, CAST(s_suppkey % 4 AS INTEGER) AS version FROM supplier WHERE s_suppkey % 9 <> 0"
_NEW = "SELECT s_suppkey AS id, 'found' AS method, concat('n', s_suppkey, '.example') AS domain, CAST(s_suppkey % 4 AS INTEGER) AS grade, 3 AS version FROM supplier WHERE s_suppkey % 2 = 0"


def _sites(spark, sf_dir):
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = lambda p: F.concat(F.lit(p), key.cast("string"), F.lit(".example"))
    old = s.where(key % 9 != 0).select(key.alias("id"), F.when(key % 5 == 0, "hand").otherwise("guess").alias("method"), F.when(key % 7 == 0, F.lit("x.platform.example")).otherwise(name("s")).alias("domain"), (key % 3).cast("int").alias("grade"), (key % 4).cast("int").alias("version"))
    new = s.where(key % 2 == 0).select(key.alias("id"), F.lit("found").alias("method"), name("n").alias("domain"), (key % 4).cast("int").alias("grade"), F.lit(3).alias("version"))
    return old, new


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM ({_OLD}))")
def snk_leads(spark, sf_dir):
    """SNK-14: leads are inserted where the key is new, and change nothing else."""
    return publish.inserted(*_sites(spark, sf_dir), ["id"])


@query(f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL OR n.grade < o.grade THEN n.method ELSE o.method END AS method, CASE WHEN o.id IS NULL OR n.grade < o.grade THEN n.domain ELSE o.domain END AS domain, CASE WHEN o.id IS NULL OR n.grade < o.grade THEN n.grade ELSE o.grade END AS grade FROM ({_OLD}) AS o FULL JOIN ({_NEW}) AS n ON n.id = o.id")
def snk_improved(spark, sf_dir):
    """SNK-15, SNK-16: only what is better replaces what is there; a working board is never lost to a worse one."""
    old, new = _sites(spark, sf_dir)
    return publish.improved(old, new, ["id"], "grade").select("id", "method", "domain", "grade")


@query(f"SELECT o.* FROM ({_OLD}) AS o WHERE EXISTS (SELECT 1 FROM ({_NEW}) AS n WHERE n.id = o.id)")
def snk_pruned(spark, sf_dir):
    """SNK-08: state without a living parent goes."""
    return publish.pruned(*_sites(spark, sf_dir), ["id"])


@query(f"WITH d AS (SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW})) SELECT d.* FROM d WHERE version >= 3 OR NOT EXISTS (SELECT 1 FROM d AS e WHERE e.id = d.id AND e.version = 3)")
def snk_superseded(spark, sf_dir):
    """SNK-19: rows of older versions go where the current one has spoken."""
    old, new = _sites(spark, sf_dir)
    return publish.latest_versions(old.unionByName(new), 3, ["id"])


@query(f"WITH k AS (SELECT * FROM ({_OLD}) WHERE method = 'hand' OR NOT ends_with(domain, '.platform.example')), n AS (SELECT * FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM k WHERE method = 'hand')) SELECT * FROM n UNION ALL SELECT * FROM k WHERE id NOT IN (SELECT id FROM n)")
def snk_protected(spark, sf_dir):
    """SNK-18: what was written by hand stays, rows on platforms go."""
    return publish.protected(*_sites(spark, sf_dir), ["id"], "method = 'hand'", "endswith(domain, '.platform.example')")


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'fixed2' WHEN id % 4 = 2 THEN 'fixed1' ELSE method END AS method, CASE WHEN id % 8 = 0 THEN 'd.example' ELSE domain END AS domain, grade, version FROM ({_OLD})")
def snk_cells(spark, sf_dir):
    """SNK-23, FED-12: corrections of single cells, the last of a cell wins."""
    old, new = _sites(spark, sf_dir)
    one = lambda c, v, k: new.select("id", F.lit(c).alias("column"), F.lit(v).alias("value"), F.lit(k).alias("seq"))
    fixes = one("method", "fixed1", 1).unionByName(one("method", "fixed2", 2).where("id % 4 = 0")).unionByName(one("domain", "d.example", 3).where("id % 8 = 0"))
    return publish.cells(old, fixes, ["id"], ["method", "domain"])


@query(f"SELECT id, method, domain, grade FROM ({_OLD}) WHERE grade > 0")
def snk_publish(spark, sf_dir):
    """SNK-06, SNK-09, SNK-24, SNK-26: a version is written, checked, made current by a rename and read back."""
    root = new_path(spark, "board")
    old, _ = _sites(spark, sf_dir)
    publish.publish(old, root, stamp="v1")
    publish.recorded(spark, root, old.agg(F.count(F.lit(1)).alias("rows")))
    publish.publish(old.where("grade > 0"), root, floor=1, stamp="v1", share=0.3)
    return publish.current(spark, root).select("id", "method", "domain", "grade")


@query("SELECT s_suppkey, concat('{\"id\":', s_suppkey, ',\"name\":\"', s_name, ' ünit\"}') AS line FROM supplier")
def jsn_export(spark, sf_dir):
    """JSN-04, SNK-20: one compact line of JSON a card, letters as they are."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" ünit")).alias("name"))).alias("line"))


# --- entities, evaluation ---


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, 'g') THEN 'group g' WHEN starts_with(p_name, 'bo') THEN 'group bo' WHEN starts_with(p_name, 'b') THEN 'group b' END AS corporate FROM part")
def ent_groups(spark, sf_dir):
    """ENT-03: corporate groups by the beginning of a name, the first of the list that fits."""
    groups = (("g", "group g"), ("bo", "group bo"), ("b", "group b"))
    first = F.coalesce(*[F.when(F.startswith("p_name", F.lit(p)), g) for p, g in groups])
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("corporate"))


@query(f"WITH j AS ({JOBS}), r AS (SELECT firm, domain, row_number() OVER (PARTITION BY firm ORDER BY ends_with(domain, '.net'), ats = 'portal', ats, id) AS k FROM j WHERE domain IS NOT NULL) SELECT firm, domain FROM r WHERE k = 1")
def ent_domain(spark, sf_dir):
    """ENT-09: of a firm's domains the best graded, then the one of the better source, then by order."""
    j = jobs(spark, sf_dir).where("domain IS NOT NULL")
    best = j.groupBy("firm").agg(F.min(F.struct(F.endswith("domain", F.lit(".net")).alias("weak"), (F.col("ats") == "portal").alias("far"), "ats", "id", "domain")).alias("b"))
    return best.select("firm", "b.domain")


@query(f"WITH j AS ({JOBS}) SELECT firm, bool_and(coalesce(relevance, 'unknown') IN ('rejected', 'unknown')) AS vetoed, bool_or(contains(' ' || coalesce(lower(title), '') || ' ', ' engineer ')) AS owned FROM j GROUP BY firm")
def ent_veto(spark, sf_dir):
    """ENT-10, ENT-11: boards all of whose postings are unrelated or silent, and boards that print what the firm is known for."""
    j = jobs(spark, sf_dir)
    return j.groupBy("firm").agg(F.bool_and(F.coalesce("relevance", F.lit("unknown")).isin("rejected", "unknown")).alias("vetoed"), F.bool_or(nm.covers(F.coalesce(F.lower("title"), F.lit("")), F.array(F.lit("engineer")))).alias("owned"))


@query("WITH r AS (SELECT o_orderkey, md5(o_orderpriority || o_clerk) AS fp FROM (SELECT o_orderkey, o_orderpriority, CAST(o_custkey % 50 AS VARCHAR) AS o_clerk FROM orders)), x AS (SELECT DISTINCT fp FROM r WHERE o_orderkey % 97 = 0) SELECT o_orderkey FROM r SEMI JOIN x USING (fp)")
def dup_rejected(spark, sf_dir):
    """DUP-05: a rejection by hand holds for reposts with the same fingerprint."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string"))).alias("fp"))
    return r.join(r.where("o_orderkey % 97 = 0").select("fp").distinct(), "fp", "left_semi").select("o_orderkey")


@query()
def dup_across(spark, sf_dir):
    """DUP-02, JON-15, TXT-15: cards of different portals with one title, overlapping places and one firm's name, transitively; tests hold it against a plain version."""
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.concat(F.lit("portal"), (F.col("p_partkey") % 3).cast("string")).alias("portal"), F.array((F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 5).cast("string")).alias("hubs"), F.col("p_name").alias("firm"), F.col("p_retailprice").alias("price"))
    return dedup.across(cards, "title", [F.col("price"), F.col("id")]).select("id", "members")


@query("WITH r AS (SELECT event_type AS source, max(ts) AS last, arg_max(event_id % 13 <> 0, (ts, event_id)) AS ok, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(last) AS now FROM r) SELECT source, CASE WHEN NOT ok THEN 'fail' WHEN now - last > INTERVAL 20 SECOND THEN 'stale' ELSE 'low' END AS kind FROM r, m WHERE NOT ok OR now - last > INTERVAL 20 SECOND OR n < 190")
def evl_stale(spark, sf_dir):
    """EVL-06, WIN-09, AGG-04: one alert a source at most: failed, stale, or below its floor."""
    own = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last"), F.max_by(F.col("event_id") % 13 != 0, F.struct("ts", "event_id")).alias("ok"), F.count(F.lit(1)).alias("n"))
    now = own.agg(F.max("last").alias("now"))
    return boards.residual_alerts(own.join(F.broadcast(now)), F.col("now") - F.col("last") > F.expr("INTERVAL 20 SECONDS"), F.col("n") < 190).select("source", "kind")


@query("WITH p AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS v FROM events), l AS (SELECT user_id, max((ts, event_id)) FILTER (ok) AS m, arg_max(v, (ts, event_id)) FILTER (ok) AS postings FROM p GROUP BY 1), s AS (SELECT p.user_id, count(*) AS failures, any_value(postings) AS postings FROM p JOIN l USING (user_id) WHERE NOT ok AND (m IS NULL OR (p.ts, p.event_id) > m) GROUP BY 1) SELECT user_id, failures, postings FROM s WHERE failures >= 2 AND postings > 0")
def evl_failing(spark, sf_dir):
    """EVL-07: boards that failed twice or more in a row and still hold postings."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("long").alias("v"))
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("m"), F.max_by(F.when(F.col("ok"), F.col("v")), F.when(F.col("ok"), F.col("at"))).alias("postings"))
    after = e.where("NOT ok").join(last, "user_id").where(F.col("m").isNull() | (F.col("at") > F.col("m")))
    return after.groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"), F.first("postings").alias("postings")).where("failures >= 2 AND postings > 0")


@query("SELECT count(*) >= 100 AND count(*) FILTER (quality = 1 AND n_chars <= 100) = 0 AND count(*) FILTER (quality = CASE WHEN n_chars > 900 THEN 1 ELSE 0 END) >= 0.9 * count(*) AND count(*) FILTER (quality = 1 AND n_chars > 900) >= 0.9 * count(*) FILTER (quality = 1) AS done, count(*) AS graded FROM documents JOIN labels USING (doc_id)")
def evl_exit(spark, sf_dir):
    """EVL-11: whether labelling may end: a hundred rows, none wrongly rejected, nine in ten agreeing and contained."""
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    good, said, n = F.col("quality") == 1, F.col("n_chars") > 900, F.count(F.lit(1))
    done = (n >= 100) & (F.count_if(good & (F.col("n_chars") <= 100)) == 0) & (F.count_if(F.col("quality") == said.cast("int")) >= 0.9 * n) & (F.count_if(good & said) >= 0.9 * F.count_if(good))
    return both.agg(done.alias("done"), n.alias("graded"))


@query("WITH a AS (SELECT o_orderkey, o_custkey AS advertised, o_orderkey % 200 AS got FROM orders) SELECT o_orderkey, CASE WHEN advertised - got > greatest(1.0, 0.02 * advertised) THEN concat('read ', got, ' of ', advertised) END AS message FROM a")
def mth_message(spark, sf_dir):
    """MTH-04, FED-02 to 06: what a walk that read too little says."""
    from ..operators.monitor import shortfall

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("advertised"), (F.col("o_orderkey") % 200).alias("got"))
    text = F.concat(F.lit("read "), F.col("got").cast("string"), F.lit(" of "), F.col("advertised").cast("string"))
    return o.select("o_orderkey", F.when(shortfall(F.col("advertised"), F.col("got")), text).alias("message"))


@query("WITH e AS (SELECT l_partkey, l_linenumber AS slice, l_suppkey % 3 AS label FROM lineitem), u AS (SELECT l_partkey, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM e GROUP BY 1), s AS (SELECT slice, count(DISTINCT l_partkey) AS got FROM e GROUP BY 1) SELECT l_partkey, labels, (SELECT count(*) FROM s WHERE got < 100) AS short FROM u")
def fed_slices(spark, sf_dir):
    """FED-03, FED-06: postings of overlapping slices are united with all their labels; slices that read too little are counted."""
    e = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("slice"), (F.col("l_suppkey") % 3).cast("string").alias("label"))
    own = e.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))
    short = e.groupBy("slice").agg(F.count_distinct("l_partkey").alias("got")).agg(F.count_if(F.col("got") < 100).alias("short"))
    return own.join(F.broadcast(short))


@query(f"WITH j AS ({JOBS}), k AS (SELECT id, last_seen, firm % 2 = 0 AS windowed FROM j) SELECT id, CASE WHEN windowed THEN last_seen < DATE '1998-07-01' - 28 ELSE last_seen < DATE '1998-07-01' END AS withdrawn FROM k")
def fed_windowed(spark, sf_dir):
    """FED-08: absence from a read that saw a window only counts after 28 days."""
    j = jobs(spark, sf_dir)
    day = F.lit("1998-07-01").cast("date")
    return j.select("id", (F.col("last_seen") < F.when(F.col("firm") % 2 == 0, F.date_sub(day, 28)).otherwise(day)).alias("withdrawn"))


@query(f"WITH j AS ({JOBS}), c AS (SELECT token, count(*) FILTER (lang NOT IN ('en', 'sv')) / count(*) AS foreign_share FROM j GROUP BY token) SELECT token, foreign_share > 0.5 AS blocked FROM c")
def fed_blocked(spark, sf_dir):
    """FED-09: a census with too many rows from elsewhere was served to somebody else, and isn't written."""
    own = jobs(spark, sf_dir).groupBy("token").agg((F.count_if(~F.col("lang").isin("en", "sv")) / F.count(F.lit(1))).alias("s"))
    return own.select("token", (F.col("s") > 0.5).alias("blocked"))


@query("WITH n AS (SELECT c_custkey, regexp_replace(trim(regexp_replace(lower(c_name), '[^0-9a-z]+', ' ', 'g')), ' 0*', ' ') AS k FROM customer), r AS (SELECT 'customer ' || s_suppkey AS k, s_suppkey FROM supplier) SELECT c_custkey, s_suppkey AS found FROM n LEFT JOIN r USING (k)")
def fed_enriched(spark, sf_dir):
    """FED-10, FED-11: a look-up by equal normalised names; misses are kept, so that they aren't asked again."""
    k = F.regexp_replace(F.trim(F.regexp_replace(F.lower("c_name"), "[^0-9a-z]+", " ")), " 0*", " ")
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("customer "), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_suppkey").alias("found"))
    return table(spark, sf_dir, "customer").select("c_custkey", k.alias("k")).join(names, "k", "left").select("c_custkey", "found")


_HUBS = ("oslo", "new_york", "paris")


@query("WITH a AS (SELECT event_id, list_filter(list_transform(string_split(CASE event_id % 4 WHEN 0 THEN ' paris, oslo' WHEN 1 THEN 'new_york,,paris ' WHEN 2 THEN '' ELSE 'oslo' END, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM events) SELECT event_id, array_to_string(list_transform(list_filter(['oslo', 'new_york', 'paris'], lambda h: list_contains(l, h)), lambda h: replace(h, '_', ' ')), '|') AS hubs, CAST(len(l) AS INTEGER) AS n FROM a")
def prj_hubs(spark, sf_dir):
    """PRJ-03, ARR-02: values split, trimmed and cleared of empty ones; hubs in the vocabulary's order, underscores as spaces."""
    e = table(spark, sf_dir, "events")
    parts = F.filter(F.transform(F.split(F.expr(pick("event_id", " paris, oslo", "new_york,,paris ", "", "oslo")), ","), lambda x: F.trim(x)), lambda x: x != "")
    order = F.transform(F.array_intersect(F.array(*[F.lit(h) for h in _HUBS]), parts), lambda h: F.replace(h, F.lit("_"), F.lit(" ")))
    return e.select("event_id", F.array_join(order, "|").alias("hubs"), F.size(parts).alias("n"))
