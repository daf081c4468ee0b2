"""Queries over captured walks: slices that are split, both ends of a window, pages in order, partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roster
from ..sources import slices
from .catalogue import query, table

_DIMS = ["label", "status", "seventh"]
_WINDOW = 250
#: orders as a board: under one or two labels, some without a status.
_BOARD = """
SELECT o_orderkey AS id, list_filter(list_distinct([o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' END]), lambda x: x IS NOT NULL) AS label,
  CASE WHEN o_orderkey % 97 <> 0 THEN o_orderstatus END AS status, CAST(o_custkey % 7 AS VARCHAR) AS seventh, o_orderdate AS t FROM orders"""
_SLICED = f"""
WITH RECURSIVE b AS ({_BOARD}),
f AS (
  SELECT id, status, seventh, t, ['label=' || v] AS slice, 1 AS depth, count(*) OVER (PARTITION BY v) AS hits FROM (SELECT *, unnest(label) AS v FROM b)
  UNION ALL
  SELECT id, status, seventh, t, slice, depth, count(*) OVER (PARTITION BY slice) AS hits FROM (
    SELECT id, status, seventh, t, list_append(slice, CASE depth WHEN 1 THEN 'status=' || status ELSE 'seventh=' || seventh END) AS slice, depth + 1 AS depth
    FROM f WHERE hits > {_WINDOW} AND depth < 3 AND CASE depth WHEN 1 THEN status ELSE seventh END IS NOT NULL)),
l AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY t DESC, id) AS r FROM f WHERE hits <= {_WINDOW} OR depth = 3)"""


def _walk(spark, sf_dir) -> tuple:
    o = table(spark, sf_dir, "orders")
    label = F.array("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "1-URGENT"))
    board = o.select(F.col("o_orderkey").alias("id"), label.alias("label"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderstatus")).alias("status"), (F.col("o_custkey") % 7).cast("string").alias("seventh"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"))
    return slices.walked(board, "id", _DIMS, _WINDOW, [F.col("age")]), board


@query(f"{_SLICED} SELECT array_to_string(slice, '/') AS slice, CAST(any_value(hits) AS BIGINT) AS hits, CAST(least(any_value(hits), {_WINDOW}) AS BIGINT) AS n_read, any_value(hits) > {_WINDOW} AS truncated FROM l GROUP BY slice")
def fed_leaves(spark, sf_dir):
    """FED-03: the slices that are read: split by the next dimension while they exceed the window, truncated where none is left."""
    return _walk(spark, sf_dir)[0].leaves.withColumn("slice", F.array_join("slice", "/"))


@query(f"{_SLICED} SELECT id, array_to_string(list_sort(list(DISTINCT substr(slice[1], 7))), '|') AS labels, count(*) AS n_leaves FROM l WHERE r <= {_WINDOW} GROUP BY id")
def fed_united(spark, sf_dir):
    """FED-03: each posting that was reached, with all labels under which it was."""
    found = slices.labelled(_walk(spark, sf_dir)[0], "id")
    return found.withColumn("labels", F.array_join("labels", "|"))


@query(f"""{_SLICED}, s AS (SELECT DISTINCT id FROM l WHERE r <= {_WINDOW}), e AS (SELECT slice, any_value(hits) AS hits FROM l GROUP BY slice),
u AS (SELECT DISTINCT id FROM f WHERE hits > {_WINDOW} AND ((depth = 1 AND status IS NULL) OR (depth = 2 AND seventh IS NULL)) AND id NOT IN (SELECT id FROM s))
SELECT (SELECT count(*) FROM b) AS advertised, (SELECT count(*) FROM s) AS seen, (SELECT count(*) FROM e) AS n_leaves, (SELECT count(*) FROM e WHERE hits > {_WINDOW}) AS n_truncated,
  (SELECT CAST(sum(hits - least(hits, {_WINDOW})) AS BIGINT) FROM e) AS n_kept_back, (SELECT count(*) FROM u) AS n_unsplit, (SELECT count(*) FROM s) >= (SELECT count(*) FROM b) AS complete""")
def fed_proof(spark, sf_dir):
    """FED-03, FED-06: whether the walk over the slices saw all that the board advertises, and what it could not."""
    walk, board = _walk(spark, sf_dir)
    return slices.proof(walk, board, "id")


_DAYS, _REACH = 14, 900


@query(f"""
WITH a AS (SELECT event_id, CAST((event_id * 7) % 23 AS INTEGER) AS age FROM events WHERE (event_id * 7) % 23 < {_DAYS}),
p AS (SELECT *, row_number() OVER (ORDER BY age, event_id) - 1 AS place FROM a),
n AS (SELECT CAST(d AS INTEGER) AS d, (SELECT count(*) FROM a WHERE age < d) AS n FROM range(1, {_DAYS} + 1) AS t(d)),
b AS (SELECT *, CASE WHEN place < {_REACH} THEN {_DAYS} ELSE (SELECT max(d) FROM n WHERE n.n - place <= {_REACH} AND d > age) END AS y FROM p),
s AS (SELECT max(d) AS stop FROM n WHERE (SELECT count(*) FROM b WHERE y >= d) >= (SELECT count(*) FROM a))
SELECT event_id, age, place, CASE WHEN y >= coalesce(stop, 1) THEN y END AS reached_by, stop IS NOT NULL AS sound FROM b, s""")
def fed_two_ended(spark, sf_dir):
    """FED-02: both ends of a window, then of shorter ones, until all was seen; whether the cursor may move."""
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7) % 23).cast("int").alias("age"))
    return slices.two_ended(e, "event_id", "age", ["event_id"], _REACH, _DAYS)


_PAGED = "CASE WHEN l_linenumber = 2 AND l_suppkey % 4 = 0 THEN {0}2, 5{1} WHEN l_linenumber = 5 AND l_suppkey % 4 = 0 THEN {0}{1} WHEN l_linenumber = 3 AND l_suppkey % 11 = 5 THEN {0}{1} ELSE {0}l_linenumber{1} END"
_STATUS = "CASE WHEN walk % 7 = 3 AND page = 4 THEN 429 WHEN walk % 13 = 1 AND page = 3 THEN 500 ELSE 200 END"
_PAGES_SQL = f"""
WITH a AS (SELECT l_suppkey AS walk, unnest({_PAGED.format('[', ']').replace('THEN []', 'THEN CAST([] AS INTEGER[])')}) AS page, l_partkey AS id FROM lineitem),
p AS (SELECT walk, page, {_STATUS} AS status, list_sort(coalesce(list(DISTINCT id) FILTER (page <> 6), [])) AS ids FROM a GROUP BY walk, page),
m AS (SELECT *, CASE WHEN page <> coalesce(lag(page) OVER (PARTITION BY walk ORDER BY page) + 1, 1) THEN 'failed' WHEN status = 429 THEN 'throttled' WHEN status <> 200 THEN 'failed'
    WHEN len(ids) = 0 THEN 'empty' WHEN row_number() OVER (PARTITION BY walk, ids ORDER BY page) > 1 THEN 'repeated' END AS why FROM p),
e AS (SELECT walk, coalesce(arg_min(why, page) FILTER (why IS NOT NULL), 'open') AS ended, coalesce(min(page) FILTER (why IS NOT NULL), max(page) + 1) AS stop FROM m GROUP BY walk)"""


def _pages(spark, sf_dir):
    paged = F.expr(_PAGED.format("array(", ")").replace("THEN array()", "THEN CAST(array() AS array<int>)"))
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("walk"), F.explode(paged).alias("page"), F.col("l_partkey").alias("id"))
    return own.groupBy("walk", "page").agg(F.sort_array(F.collect_set(F.when(F.col("page") != 6, F.col("id")))).alias("ids")).withColumn("status", F.expr(_STATUS))


@query(f"{_PAGES_SQL} SELECT e.walk, count(DISTINCT m.page) AS n_pages, (SELECT count(DISTINCT i) FROM (SELECT unnest(ids) AS i FROM m AS x WHERE x.walk = e.walk AND x.page < e.stop)) AS n_rows, ended, ended = 'empty' AS complete FROM e LEFT JOIN m ON m.walk = e.walk AND m.page < e.stop GROUP BY e.walk, ended, stop")
def fed_sequences(spark, sf_dir):
    """FED-04, FED-05: walks over pages: only an empty page ends one well; a repeated page, haste and failures keep what came before."""
    return slices.sequences(_pages(spark, sf_dir), "walk")


@query(f"{_PAGES_SQL} SELECT DISTINCT e.walk, unnest(ids) AS id FROM e JOIN m ON m.walk = e.walk AND m.page < e.stop")
def fed_sequence_rows(spark, sf_dir):
    """FED-04, FED-05: what such walks read."""
    return slices.sequence_rows(_pages(spark, sf_dir), "walk")


@query("""
WITH r AS (SELECT DISTINCT l_partkey, l_suppkey % 29 AS part FROM lineitem WHERE l_suppkey % 29 <> 4), s AS (SELECT l_partkey, count(*) AS n FROM r GROUP BY 1),
g AS (SELECT part, count(*) AS got, count(*) FILTER (n > 1) AS shared FROM r JOIN s USING (l_partkey) GROUP BY part),
a AS (SELECT l_suppkey % 29 AS part, count(DISTINCT l_partkey) AS advertised FROM lineitem WHERE l_suppkey % 29 <> 7 GROUP BY 1)
SELECT part, advertised, coalesce(got, 0) AS got, coalesce(shared, 0) AS shared, coalesce(coalesce(got, 0) = advertised AND coalesce(shared, 0) = 0, false) AS sound FROM a FULL JOIN g USING (part)""")
def fed_shares(spark, sf_dir):
    """FED-06: each part of a partition against what it advertises, and keys that other parts have too."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 29).alias("part"))
    said = rows.where("part <> 7").groupBy("part").agg(F.count_distinct("l_partkey").alias("advertised"))
    return slices.shares(rows.where("part <> 4"), "l_partkey", "part", said)


_LINKS = "CASE o_orderkey % 5 WHEN 0 THEN {0}{1} WHEN 1 THEN {0}concat('u', o_orderkey * 2 + 1){1} WHEN 2 THEN {0}concat('u', o_orderkey + 3), concat('u', o_orderkey * 3 % 1000), concat('u', o_orderkey + 3){1} ELSE {0}concat('u', o_orderkey + 1), concat('u', o_orderkey + 2), concat('u', o_orderkey * 7 % 900), concat('u', o_orderkey - 5), concat('u', o_orderkey * 11 % 800){1} END"
_WEB = "SELECT concat('u', o_orderkey) AS url, o_custkey % 6 <> 0 AS readable, {links} AS links, CASE WHEN o_custkey % 13 = 0 THEN concat('v', o_custkey % 3) END AS vendor FROM orders"


@query(f"""
WITH p AS ({_WEB.format(links=_LINKS.format('[', ']').replace('THEN []', 'THEN CAST([] AS VARCHAR[])'))}), t AS (SELECT url, readable, CASE WHEN readable THEN vendor END AS vendor, CASE WHEN readable THEN list_filter(links, lambda x, i: list_position(links, x) = i) ELSE [] END AS links FROM p),
s AS (SELECT o_orderkey AS site, concat('u', o_orderkey) AS home FROM orders WHERE o_orderkey % 3 = 0),
h AS (SELECT site, home, coalesce(readable, false) AS readable, vendor, coalesce(links, []) AS links FROM s LEFT JOIN t ON t.url = home),
f AS (SELECT site, x AS url, k AS turn FROM (SELECT site, unnest(links) AS x, unnest(range(0, len(links))) AS k FROM h WHERE readable AND vendor IS NULL) WHERE k < 6),
g AS (SELECT f.*, coalesce(readable, false) AS readable, vendor, coalesce(links, []) AS links FROM f LEFT JOIN t USING (url)),
n AS (SELECT site, count(*) AS n, bool_or(vendor IS NOT NULL) AS hit FROM g GROUP BY site),
d AS (SELECT site, n, x AS url, min({{'a': turn, 'b': k}}) AS o FROM (SELECT g.site, n.n, turn, unnest(links) AS x, unnest(range(0, len(links))) AS k FROM g JOIN n ON n.site = g.site AND NOT n.hit AND n.n < 6 WHERE readable) GROUP BY site, n, x),
e AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY o, url) AS r FROM d ANTI JOIN f ON f.site = d.site AND f.url = d.url),
w AS (SELECT site, url, turn, readable, vendor FROM g UNION ALL SELECT site, e.url, n + r - 1, coalesce(readable, false), vendor FROM e LEFT JOIN t ON t.url = e.url WHERE n + r <= 6),
r AS (SELECT site, min({{'a': turn, 'u': url, 'v': vendor}}) FILTER (vendor IS NOT NULL) AS hit, min({{'a': turn, 'u': url}}) FILTER (readable) AS ok, count(*) AS n FROM w GROUP BY site)
SELECT h.site, CASE WHEN vendor IS NOT NULL OR hit IS NOT NULL THEN 'A' WHEN ok IS NOT NULL THEN 'B' ELSE 'C' END AS tier, CASE WHEN vendor IS NOT NULL THEN home ELSE coalesce(hit.u, ok.u) END AS url, coalesce(vendor, hit.v) AS vendor,
  CASE WHEN NOT readable THEN 'home unreadable' WHEN vendor IS NOT NULL THEN 'vendor on the home page' WHEN len(links) = 0 THEN 'no link' WHEN hit IS NOT NULL THEN 'vendor' WHEN ok IS NOT NULL THEN 'readable page' ELSE 'links unreadable' END AS why,
  CAST(coalesce(hit.a + 1, r.n, 0) AS BIGINT) AS n_fetched FROM h LEFT JOIN r USING (site)""")
def src_two_hops(spark, sf_dir):
    """SRC-14: sites resolved over two hops of captured pages, six a site at most, the best tier kept."""
    links = _LINKS.format("array(", ")").replace("THEN array()", "THEN CAST(array() AS array<string>)")
    pages = table(spark, sf_dir, "orders").selectExpr("concat('u', o_orderkey) AS url", "o_custkey % 6 <> 0 AS readable", f"{links} AS links", "CASE WHEN o_custkey % 13 = 0 THEN concat('v', o_custkey % 3) END AS vendor")
    sites = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS site", "concat('u', o_orderkey) AS home")
    return slices.two_hops(sites, pages)


# --- rosters ---

_ROSTER = "SELECT c_nationkey AS hub, CASE WHEN c_nationkey % 2 = 0 THEN 'focus' ELSE 'other' END AS priority, concat('Firm ', c_custkey % 300, 'x') AS name, c_custkey % 17 = 0 AS absent FROM customer"
_TARGETS = "SELECT DISTINCT concat('Firm ', c_custkey % 300, 'x') AS label, CASE WHEN c_custkey % 300 % 3 <> 0 THEN concat('d', c_custkey % 300, '.example') END AS domain, {0}concat('Firm ', c_custkey % 300, 'X AB'), concat('firm ', c_custkey % 300, 'x'), concat(c_custkey % 300, 'x'){1} AS names FROM customer WHERE c_custkey % 300 % 11 <> 0"
_OPEN = "SELECT CASE WHEN o_custkey % 4 <> 1 THEN concat('d', o_custkey % 350, '.example') END AS domain, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('The FIRM ', o_custkey % 350, 'x ab') ELSE concat('Northern ', o_custkey % 350, 'x') END AS employer, o_orderstatus = 'O' AS portal, o_orderpriority = '5-LOW' AS removed, concat('a', o_custkey % 3) AS ats, concat('t', o_custkey % 90) AS token FROM orders"
_SOLVED = "SELECT concat('d', s_suppkey * 7 % 400, '.example') AS domain, CASE WHEN s_suppkey % 4 = 0 THEN 'B' ELSE 'A' END AS tier, concat('a', s_suppkey % 3) AS ats, CASE WHEN s_suppkey % 9 <> 0 THEN concat('t', s_suppkey % 120) END AS token, s_suppkey % 5 = 0 AS portal FROM supplier"
_LINES_SQL = f"""
WITH ro AS ({_ROSTER}), ta AS ({_TARGETS.format('[', ']')}), jo AS ({_OPEN}), so AS ({_SOLVED}),
pd AS (SELECT domain, count(*) AS n FROM jo WHERE portal AND NOT removed AND domain IS NOT NULL GROUP BY domain),
em AS (SELECT lower(employer) AS employer, count(*) AS n FROM jo WHERE portal AND NOT removed AND employer IS NOT NULL GROUP BY 1),
na AS (SELECT label, unnest(names) AS name, unnest(range(0, len(names))) AS k FROM ta LEFT JOIN pd USING (domain) WHERE pd.n IS NULL),
sp AS (SELECT label, k, CAST(sum(n) AS BIGINT) AS n FROM na JOIN em ON contains(employer, lower(name)) GROUP BY label, k),
po AS (SELECT ta.label, ta.domain, coalesce(pd.n, (SELECT arg_min(n, k) FROM sp WHERE sp.label = ta.label), 0) AS portal FROM ta LEFT JOIN pd USING (domain)),
un AS (SELECT domain, count(*) AS n FROM jo WHERE NOT portal AND NOT removed AND domain IS NOT NULL GROUP BY domain),
bo AS (SELECT ats, token, count(*) AS n FROM jo WHERE NOT removed GROUP BY ats, token),
kn AS (SELECT domain, max(coalesce(n, 0)) AS n FROM so LEFT JOIN bo USING (ats, token) WHERE tier = 'A' AND token IS NOT NULL AND NOT portal GROUP BY domain),
li AS (SELECT hub, priority, name, po.domain, greatest(coalesce(un.n, 0), coalesce(kn.n, 0)) AS postings, coalesce(portal, 0) AS portal, kn.domain IS NOT NULL AS board
  FROM ro LEFT JOIN po ON label = name LEFT JOIN un ON un.domain = po.domain LEFT JOIN kn ON kn.domain = po.domain WHERE NOT absent),
x AS (SELECT *, postings > 0 AS polled, postings > 0 OR board AS reached, NOT (postings > 0 OR board) AND portal > 0 AS portal_only FROM li)"""


def _lines(spark, sf_dir):
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    pick = lambda df, sql: df.selectExpr(*_columns(sql.split(" FROM ")[0].removeprefix("SELECT ").removeprefix("DISTINCT ")))
    targets = pick(c.where("c_custkey % 300 % 11 <> 0"), _TARGETS.format("array(", ")")).distinct()
    return roster.followed(pick(c, _ROSTER), targets, pick(o, _OPEN), pick(s, _SOLVED))


def _columns(select: str) -> list[str]:
    """The expressions of a SELECT, parted at commas outside parentheses."""
    out, depth = [""], 0
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query(f"{_LINES_SQL} SELECT * FROM x")
def ent_roster(spark, sf_dir):
    """ENT-07, ENT-08, JON-13: roster lines with their own board's postings, portal's by the first spelling that hits, and who is on a portal only."""
    return _lines(spark, sf_dir)


@query(f"{_LINES_SQL} SELECT priority, hub, count(*) AS lines, count(*) FILTER (reached) AS reached, count(*) FILTER (polled) AS producing, count(*) FILTER (portal_only) AS portal_only, CAST(coalesce(sum(postings) FILTER (polled), 0) AS BIGINT) AS postings FROM x GROUP BY priority, hub")
def agg_hub_rates(spark, sf_dir):
    """AGG-26: rates by hub, of lines."""
    return roster.hub_rates(_lines(spark, sf_dir))


@query(f"{_LINES_SQL}, f AS (SELECT lower(trim(name)) AS firm, bool_or(reached) AS r, bool_or(polled) AS p, bool_or(portal_only) AS o FROM x GROUP BY 1) SELECT count(*) AS firms, count(*) FILTER (r) AS reached, count(*) FILTER (p) AS producing, count(*) FILTER (o AND NOT r) AS portal_only FROM f")
def evl_roster(spark, sf_dir):
    """EVL-12: the headline, of firms."""
    return roster.headline(_lines(spark, sf_dir))


@query(f"{_LINES_SQL} SELECT DISTINCT hub, name, portal, domain FROM x WHERE priority = 'focus' AND NOT reached")
def evl_missing(spark, sf_dir):
    """EVL-12: firms of the focus hubs that no board reaches."""
    return roster.missing(_lines(spark, sf_dir), "focus")
