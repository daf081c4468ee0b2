"""Queries over tables: joins, aggregates, set operations, upserts, entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import identity, merge, monitor, search
from .catalogue import query, table


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def agg_conditional(spark, sf_dir):
    """AGG-01, AGG-03, AGG-05."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT n_name, count(*) AS postings, count(DISTINCT c_custkey) AS employers, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS shortlisted FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def agg_yield(spark, sf_dir):
    """AGG-03, EVL-04, JON-02: rows, distinct parents and shortlisted rows by place."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("c_custkey").alias("employers"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("shortlisted"))


@query("SELECT o_custkey, max(o_orderdate) AS started_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY ALL")
def agg_last_run(spark, sf_dir):
    """AGG-06: the row of the latest time, ties broken by id."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("started_at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, length(c_mktsegment), c_mktsegment) AS r FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE r = 1")
def agg_commonest(spark, sf_dir):
    """AGG-14: the commonest value; of ties the shortest, then the smallest."""
    return identity.commonest(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT l_returnflag, string_agg(l_shipmode, '|' ORDER BY l_shipmode) AS modes, median(n) AS median_n FROM (SELECT l_returnflag, l_linestatus || '-' || l_linenumber AS l_shipmode, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def agg_listagg(spark, sf_dir):
    """AGG-16, AGG-17."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("mode")), "|").alias("modes"), F.median("n").alias("median_n"))


@query("SELECT count(*) AS n, count(*) FILTER (c_acctbal > 0) AS solvent, count(DISTINCT c_nationkey) AS nations, bool_or(c_acctbal < -900) AS any_low, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS building FROM customer")
def agg_coverage(spark, sf_dir):
    """AGG-18, AGG-19: one row of counts in one pass."""
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"), F.count_distinct("c_nationkey").alias("nations"), F.bool_or(F.col("c_acctbal") < -900).alias("any_low"), F.sum((F.col("c_mktsegment") == "BUILDING").cast("long")).alias("building"))


@query("SELECT l_suppkey, n, hits, undecided, (hits + undecided / 4.0) / n AS share, n >= 20 AND (hits + undecided / 4.0) / n >= 0.5 AS keep FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS hits, count(*) FILTER (l_returnflag = 'A') AS undecided FROM lineitem GROUP BY ALL)")
def agg_profile(spark, sf_dir):
    """AGG-12, AGG-13, AGG-23: the share of a group that is kept, undecided rows for a quarter, with floors."""
    rows = table(spark, sf_dir, "lineitem").withColumn("verdict", F.when(F.col("l_returnflag") == "N", "keep").when(F.col("l_returnflag") == "A", "undecided").otherwise("reject"))
    return search.profile(rows, ["l_suppkey"], "verdict", 20, 0.5)


@query("SELECT s, n, domain FROM (SELECT l_suppkey AS s, CAST(l_partkey % 5 AS VARCHAR) AS domain, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, CAST(l_partkey % 5 AS VARCHAR) DESC) AS r FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY l_suppkey, l_partkey % 5) WHERE r = 1")
def agg_domain(spark, sf_dir):
    """AGG-11: the domain of most rows; of ties the larger name."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 5).cast("string")).alias("domain"))
    return search.chosen_domain(rows, ["s"])


@query("SELECT CASE WHEN n_chars < 200 THEN 'tiny' WHEN lang <> 'en' THEN 'foreign' WHEN source LIKE 'src1%' THEN 'first' ELSE 'other' END AS cause, count(*) AS n FROM documents GROUP BY ALL")
def agg_causes(spark, sf_dir):
    """AGG-21: the first cause that fits."""
    cause = F.when(F.col("n_chars") < 200, "tiny").when(F.col("lang") != "en", "foreign").when(F.col("source").like("src1%"), "first").otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars % 7 = 0) AS silent, count(*) FILTER (n_chars % 7 <> 0 AND quality = CASE WHEN n_chars > 900 THEN 1 ELSE 0 END) AS agreed, CASE WHEN count(*) > count(*) FILTER (n_chars % 7 = 0) THEN count(*) FILTER (n_chars % 7 <> 0 AND quality = CASE WHEN n_chars > 900 THEN 1 ELSE 0 END) / (count(*) - count(*) FILTER (n_chars % 7 = 0)) END AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def evl_agreement(spark, sf_dir):
    """AGG-24, EVL-10, JON-16, MTH-02: agreement of a verdict with labels."""
    said = F.when(F.col("n_chars") % 7 != 0, (F.col("n_chars") > 900).cast("int"))
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("said", said)
    return monitor.agreement(both, "quality", "said", ["lang"])


@query("SELECT count(*) FILTER (quality = 1 AND n_chars > 900) AS kept, count(*) FILTER (quality = 1 AND n_chars <= 900) AS lost, count(*) FILTER (quality = 1) AS graded FROM documents JOIN labels USING (doc_id)")
def evl_containment(spark, sf_dir):
    """AGG-25, EVL-11."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    good, big = F.col("quality") == 1, F.col("n_chars") > 900
    return both.agg(F.count_if(good & big).alias("kept"), F.count_if(good & ~big).alias("lost"), F.count_if(good).alias("graded"))


_USERS = "(SELECT DISTINCT user_id FROM events WHERE event_type = '{}')"


@query(f"WITH c AS (SELECT (SELECT count(*) FROM {_USERS.format('click')}) AS n_first, (SELECT count(*) FROM {_USERS.format('purchase')}) AS n_second, (SELECT count(*) FROM {_USERS.format('click')} JOIN {_USERS.format('purchase')} USING (user_id)) AS n_both) SELECT n_first, n_second, n_both AS \"both\", CASE WHEN n_both >= 5 THEN CAST(floor((n_first + 1) * (n_second + 1) / (n_both + 1) - 1) AS BIGINT) END AS estimate FROM c")
def evl_chapman(spark, sf_dir):
    """SET-02, MTH-01, EVL-01: capture-recapture over the users of two kinds of events."""
    e = table(spark, sf_dir, "events")
    own = monitor.overlap(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id")
    return own.withColumn("estimate", tx.chapman(F.col("n_first"), F.col("n_second"), F.col("both")))


@query("SELECT DISTINCT c_custkey, c_mktsegment FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jon_missed(spark, sf_dir):
    """JON-03, JON-05, EVL-02: parents with rows, none of them of a kind."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf_dir, "customer").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_anti").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def jon_left(spark, sf_dir):
    """JON-06 to 11, JON-18: a left join to rows aggregated first, as a correlated subquery would see them."""
    own = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    both = table(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query(r"WITH r AS (SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] AS name FROM part WHERE p_partkey % 50 = 0) SELECT p_partkey, name FROM part JOIN r ON contains(' ' || p_name || ' ', ' ' || name || ' ')")
def jon_containment(spark, sf_dir):
    """JON-12, JON-13: names contained in others as a run of tokens, by an equi-join on one token and a check of the rest."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    w = F.split("p_name", " ")
    names = part.where("p_partkey % 50 = 0").where(F.size(w) >= 2).select(F.concat_ws(" ", w[0], w[1]).alias("name"), w[0].alias("token")).distinct()
    rows = part.select("p_partkey", "p_name", F.explode(F.array_distinct(w)).alias("token"))
    return rows.join(names, "token").where(F.contains(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" ")))).select("p_partkey", "name")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 300000 UNION SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def set_union(spark, sf_dir):
    """SET-01: arms of a queue, distinct, then one order and limit."""
    o = table(spark, sf_dir, "orders")
    arms = [o.where(c).select("o_orderkey", "o_orderdate") for c in ("o_orderpriority = '1-URGENT'", "o_totalprice > 300000", "o_orderstatus = 'P'")]
    return arms[0].unionByName(arms[1]).unionByName(arms[2]).distinct().orderBy("o_orderdate", "o_orderkey").limit(100)


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def set_difference(spark, sf_dir):
    """SET-03, SET-04, EVL-03, EVL-05, EVL-08."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id").distinct().join(e.where("event_type = 'error'"), "user_id", "left_anti")


@query("WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id) SELECT user_id, array_to_string(kinds, '|') AS kinds, len(list_filter(kinds, lambda x: x NOT IN ('click', 'view', 'error'))) = 0 AS subset, list_has_any(kinds, ['purchase', 'signup']) AS overlaps FROM s")
def set_subset(spark, sf_dir):
    """SET-05, SET-06, AGG-20."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    return own.select("user_id", F.array_join("kinds", "|").alias("kinds"), (F.size(F.array_except("kinds", lits("click", "view", "error"))) == 0).alias("subset"), F.arrays_overlap("kinds", lits("purchase", "signup")).alias("overlaps"))


_OLD = "SELECT o_orderkey AS id, o_orderstatus AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS employer, CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderkey % 9, ' Locations') ELSE concat('City ', o_orderkey % 9) END AS location, o_orderdate AS seen FROM orders WHERE o_orderkey % 5 <> 0"
_NEW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS title, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'E' END AS employer, CASE WHEN o_orderkey % 6 = 0 THEN '2 Locations' ELSE concat('Town ', o_orderkey % 3) END AS location, o_orderdate + INTERVAL 30 DAY AS seen FROM orders WHERE o_orderkey % 3 <> 1"


def _two(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = lambda a, n: F.concat(F.lit(a), (key % n).cast("string"))
    old = o.where(key % 5 != 0).select(key.alias("id"), F.col("o_orderstatus").alias("title"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("employer"), F.when(key % 4 == 0, F.concat((key % 9).cast("string"), F.lit(" Locations"))).otherwise(text("City ", 9)).alias("location"), F.col("o_orderdate").alias("seen"))
    new = o.where(key % 3 != 1).select(key.alias("id"), F.when(key % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("title"), F.when(key % 7 != 0, F.lit("E")).alias("employer"), F.when(key % 6 == 0, F.lit("2 Locations")).otherwise(text("Town ", 3)).alias("location"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("seen"))
    return old, new


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN a.title ELSE b.title END AS title, coalesce(b.employer, a.employer) AS employer, CASE WHEN b.id IS NULL THEN a.location WHEN a.id IS NULL THEN b.location WHEN regexp_matches(b.location, '^[0-9]+ Locations$') AND NOT regexp_matches(a.location, '^[0-9]+ Locations$') THEN a.location ELSE b.location END AS location, least(a.seen, b.seen) AS first_seen, greatest(a.seen, b.seen) AS last_seen FROM a FULL JOIN b ON a.id = b.id")
def snk_upsert(spark, sf_dir):
    """SNK-01, SNK-02, TXT-31, UDF-01: an upsert with a rule for each column."""
    old, new = (x.withColumns({"first_seen": F.col("seen"), "last_seen": F.col("seen")}) for x in _two(spark, sf_dir))
    return merge.upsert(old, new, ["id"], {"title": "new", "employer": "coalesce", "location": tx.resolved_place, "first_seen": "first", "last_seen": "last"})


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT a.id FROM a JOIN b ON a.id = b.id WHERE a.title IS DISTINCT FROM b.title OR a.employer IS DISTINCT FROM b.employer")
def snk_changed(spark, sf_dir):
    """SNK-04, SNK-05: keys whose evidence changed, nulls compared as values."""
    return merge.changed(*_two(spark, sf_dir), ["id"], ["title", "employer"])


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)")
def snk_rebuild(spark, sf_dir):
    """SNK-11, SET-07, SNK-03, SNK-14: incoming rows and the stored ones they don't replace."""
    old, new = _two(spark, sf_dir)
    return merge.rebuilt(old, new, ["id"])


@query(f"WITH a AS (SELECT id, CASE WHEN id % 11 = 0 THEN seen END AS removed_at FROM ({_OLD})), b AS ({_NEW}) SELECT a.id, CASE WHEN b.id IS NOT NULL THEN NULL ELSE coalesce(a.removed_at, TIMESTAMP '2030-01-01') END AS removed_at FROM a LEFT JOIN b ON a.id = b.id")
def snk_snapshot(spark, sf_dir):
    """SNK-12, STR-07, FED-07: what a complete read lacks is withdrawn, what is back is revived."""
    old, new = _two(spark, sf_dir)
    stored = old.select("id", F.when(F.col("id") % 11 == 0, F.col("seen")).alias("removed_at"))
    return merge.snapshot(stored, new, ["id"], F.lit("2030-01-01").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def snk_last_write(spark, sf_dir):
    """SNK-10, SNK-13, ARR-03: the last write of a key wins."""
    return merge.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


_KEYS = "k AS (SELECT s_suppkey AS id, 1 AS kind_rank, 'g' || (s_suppkey // 4) AS key FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 2, 'd' || (s_suppkey % 17) FROM supplier WHERE s_suppkey % 5 = 0)"


@query(f"WITH RECURSIVE {_KEYS}, e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k AS a JOIN k AS b ON a.key = b.key), r AS (SELECT s_suppkey AS node, s_suppkey AS root FROM supplier UNION SELECT r.node, e.y FROM r JOIN e ON r.root = e.x), c AS (SELECT node, min(root) AS root FROM r GROUP BY node), b AS (SELECT c.root, arg_min(k.key, (k.kind_rank, k.key)) AS entity FROM c JOIN k ON k.id = c.node GROUP BY c.root) SELECT c.node AS id, coalesce(b.entity, CAST(c.node AS VARCHAR)) AS entity FROM c LEFT JOIN b ON b.root = c.root")
def ent_resolve(spark, sf_dir):
    """ENT-01, ENT-04, ENT-05: rows that share a key are one entity, named by its strongest key."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    group = s.where("id % 3 = 0").select("id", F.lit(1).alias("kind_rank"), F.concat(F.lit("g"), F.floor(F.col("id") / 4).cast("string")).alias("key"))
    domain = s.where("id % 5 = 0").select("id", F.lit(2).alias("kind_rank"), F.concat(F.lit("d"), (F.col("id") % 17).cast("string")).alias("key"))
    return identity.resolved(s, group.unionByName(domain)).select("id", "entity")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 4")
def ent_ambiguous(spark, sf_dir):
    """ENT-02: keys that too many names share."""
    keys = table(spark, sf_dir, "customer").select(F.lit("domain").alias("kind"), F.col("c_nationkey").cast("string").alias("key"), F.col("c_mktsegment").alias("name"))
    return identity.ambiguous(keys, "domain", "name", 4)
