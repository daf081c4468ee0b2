"""Queries that need an order: histories, streaks, draws, queues, dates, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import buckets, monitor, sampling
from ..operators.tables import new_path
from ..streaming import feeds
from .catalogue import query, table

_RUNS = "runs AS (SELECT event_type AS source, CAST(ts AS DATE) AS started_at, min(event_id) AS id, CASE WHEN min(event_id) % 19 = 0 THEN 0 ELSE count(*) END AS row_count, min(event_id) % 13 <> 0 AS ok FROM events GROUP BY ALL)"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("started_at")).agg(F.min("event_id").alias("id"), F.count(F.lit(1)).alias("n"))
    return e.select("source", "started_at", "id", F.when(F.col("id") % 19 == 0, 0).otherwise(F.col("n")).alias("row_count"), (F.col("id") % 13 != 0).alias("ok"))


@query(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS rn FROM runs), g AS (SELECT source, max(row_count) FILTER (rn = 1) AS latest, bool_and(ok) FILTER (rn = 1) AS ok, median(row_count) FILTER (rn > 1 AND ok AND row_count > 0) AS baseline, count(*) FILTER (rn > 1 AND ok AND row_count > 0) AS h FROM r GROUP BY source), k AS (SELECT *, CASE WHEN NOT ok THEN 'fail' WHEN latest = 0 THEN 'empty' WHEN h >= 2 AND latest < 0.95 * baseline THEN 'shrank' END AS kind FROM g) SELECT source, kind, latest, baseline FROM k WHERE kind IS NOT NULL")
def evl_alerts(spark, sf_dir):
    """EVL-06, WIN-01, WIN-02, AGG-16: sources whose latest run failed, was empty or shrank against the median of earlier ones."""
    return monitor.alerts(_runs(spark, sf_dir), floor=0.95)


_POLLS = "SELECT user_id AS board, event_id AS poll_id, ts AS polled_at, event_type <> 'error' AS ok, CAST(value AS BIGINT) AS postings FROM events"


def _polls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("board"), F.col("event_id").alias("poll_id"), F.col("ts").alias("polled_at"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("long").alias("postings"))


@query("WITH p AS (SELECT user_id AS board, event_id AS poll_id, ts, event_type <> 'error' AS ok FROM events), q AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY board ORDER BY ts, poll_id) AS g FROM p) SELECT board, poll_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY board, g ORDER BY ts, poll_id) AS BIGINT) AS failures FROM q")
def win_streaks(spark, sf_dir):
    """WIN-03, SNK-07, STR-05: failures in a row, set to 0 by a success."""
    return monitor.streaks(_polls(spark, sf_dir), ["board"], [F.col("polled_at"), F.col("poll_id")]).select("board", "poll_id", "failures")


@query("WITH p AS (SELECT user_id AS board, event_id, ts, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS postings FROM events), l AS (SELECT board, arg_max(postings, (ts, event_id)) FILTER (ok) AS postings, max(ts) FILTER (ok) AS last_ok, max((ts, event_id)) FILTER (ok) AS m FROM p GROUP BY board) SELECT l.board, CAST((SELECT count(*) FROM p WHERE p.board = l.board AND NOT ok AND (l.m IS NULL OR (p.ts, p.event_id) > l.m)) AS BIGINT) AS failures, postings, last_ok FROM l")
def snk_health(spark, sf_dir):
    """SNK-07, EVL-07: a board's state; the last postings survive failures."""
    return monitor.health(_polls(spark, sf_dir), ["board"], [F.col("polled_at"), F.col("poll_id")])


@query("WITH c AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT *, r > 1 AND event_type IS DISTINCT FROM b AS changed FROM c) SELECT event_id, changed, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS changes FROM d")
def win_changes(spark, sf_dir):
    """WIN-04, SNK-17, STR-06: what changed since the snapshot before."""
    return monitor.changes(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "changed", "changes")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def win_asof(spark, sf_dir):
    """WIN-10, WIN-11: the nearest heading before each match, and where the next match starts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    heading = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", heading.alias("heading"), F.lead("turn").over(w).alias("next_turn"))


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_brand, p_name, p_partkey) AS r FROM part) WHERE r = 1")
def win_keep_first(spark, sf_dir):
    """WIN-08, SET-08: the first of each key in a stable order."""
    w = Window.partitionBy("p_type", "p_size").orderBy("p_brand", "p_name", "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r = 1").select("p_partkey", "p_brand")


@query("SELECT event_type FROM events GROUP BY event_type HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 2 MINUTE")
def win_stale(spark, sf_dir):
    """WIN-09, DAT-06: steps whose last check lies too far back from the newest of all."""
    own = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    newest = own.agg(F.max("last").alias("now"))
    return own.join(F.broadcast(newest)).where(F.col("now") - F.col("last") > F.expr("INTERVAL 2 MINUTES")).select("event_type")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders")
def win_interleave(spark, sf_dir):
    """WIN-06: turns of groups; sorted by turn and group they alternate."""
    out = sampling.interleaved(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")])
    return out.select("o_orderkey", "o_custkey", "turn")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 100")
def srt_ranked(spark, sf_dir):
    """SRT-01, SRT-02, SRT-05, SRT-12: the first hundred by rank and newness."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(100)


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS polled FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY polled NULLS FIRST, c_custkey LIMIT 100")
def srt_never_first(spark, sf_dir):
    """SRT-03, SRT-04, JON-08: the hundred tried longest ago, those never tried first."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("polled"))
    both = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.orderBy(F.asc_nulls_first("polled"), "c_custkey").select("c_custkey").limit(100)


@query("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)), o_orderkey LIMIT 200")
def srt_sample(spark, sf_dir):
    """SRT-09, SRT-11, HSH-03: two hundred rows by the digest of their keys, a draw that any rerun repeats."""
    return sampling.uniform(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], 200).select("o_orderkey")


@query("WITH d AS (SELECT o_orderkey, o_orderstatus, o_custkey, md5(CAST(o_orderkey AS VARCHAR)) AS d FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY d, o_orderkey) AS c FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY d, o_orderkey) AS r FROM c WHERE c <= 2) SELECT o_orderkey, o_orderstatus FROM r WHERE r <= CASE o_orderstatus WHEN 'F' THEN 35 WHEN 'O' THEN 35 WHEN 'P' THEN 30 ELSE 0 END")
def srt_stratified(spark, sf_dir):
    """SRT-10, WIN-05: quotas by stratum, two rows of a board at most."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return sampling.stratified(o, "o_orderstatus", {"F": 35, "O": 35, "P": 30}, ["o_orderkey"], "o_custkey", 2).select("o_orderkey", "o_orderstatus")


_POSTED = "CASE o_orderkey % 7 WHEN 0 THEN '1700000000000' WHEN 1 THEN '2024-03-05T10:00' WHEN 2 THEN 'Posted today' WHEN 3 THEN 'Posted Yesterday' WHEN 4 THEN '30+ days ago' WHEN 5 THEN concat(o_orderkey % 20, ' days ago') ELSE '2 months ago' END"


@query(f"WITH a AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN DATE '2023-11-14' WHEN 1 THEN DATE '2024-03-05' WHEN 2 THEN d WHEN 3 THEN d - 1 WHEN 4 THEN d - 30 WHEN 5 THEN d - CAST(o_orderkey % 20 AS INTEGER) ELSE d - 60 END AS posted, CASE k WHEN 4 THEN 'atleast' WHEN 5 THEN 'approx' WHEN 6 THEN 'approx' ELSE 'exact' END AS precision FROM a")
def dat_loose(spark, sf_dir):
    """DAT-01, DAT-02: dates as boards write them."""
    posted = tx.loose_date(F.expr(_POSTED), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", posted.alias("p")).select("o_orderkey", F.col("p.date").alias("posted"), F.col("p.precision").alias("precision"))


@query("SELECT o_orderkey, (o_custkey - o_orderkey % 200) > greatest(1.0, 0.02 * o_custkey) AS short FROM orders")
def mth_shortfall(spark, sf_dir):
    """MTH-03, MTH-04: walks that read too little of what was advertised."""
    return table(spark, sf_dir, "orders").select("o_orderkey", monitor.shortfall(F.col("o_custkey"), F.col("o_orderkey") % 200).alias("short"))


_FEED = "WITH a AS (SELECT event_id % 500 AS id, ts, event_id, event_type = 'error' AS removed, event_type || CAST(floor(value) AS INTEGER) AS title FROM events), l AS (SELECT id, arg_max(removed, (ts, removed, title)) AS r, max(ts) AS ts FROM a GROUP BY id), t AS (SELECT id, arg_max(title, (ts, title)) AS title FROM a WHERE NOT removed GROUP BY id) SELECT l.id, t.title, CASE WHEN l.r THEN l.ts END AS removed_at FROM l LEFT JOIN t ON t.id = l.id"


@query(_FEED)
def str_feed(spark, sf_dir):
    """FED-01, STR-01 to 04, STR-08, SNK-13, SNK-27: the table after all ads of a delta feed with tombstones."""
    e = table(spark, sf_dir, "events")
    return feeds.state_of(e.select((F.col("event_id") % 500).alias("id"), "ts", (F.col("event_type") == "error").alias("removed"), F.concat("event_type", F.floor("value").cast("int").cast("string")).alias("title")))


@query(_FEED)
def str_feed_stream(spark, sf_dir):
    """The same feed, replayed as files through Structured Streaming."""
    root = new_path(spark, "feed")
    e = table(spark, sf_dir, "events")
    ads = e.select((F.col("event_id") % 500).alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("removed"), F.concat("event_type", F.floor("value").cast("int").cast("string")).alias("title"))
    ads.repartition(4).write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/in")
    feeds.run_feed(spark, f"{root}/in", f"{root}/log", f"{root}/offsets")
    state = feeds.state_of(spark.read.parquet(f"{root}/log").drop("batch"))
    return state.withColumn("removed_at", F.col("removed_at").cast("timestamp_ntz"))


@query(_FEED)
def str_feed_state(spark, sf_dir):
    """STR-01 to 05, SNK-13, SNK-27: the same feed as state: changes of postings, number of the batch and cursor are committed as one version of a
    table in buckets. Files, state and table are written when the query is built."""
    root, provider = new_path(spark, "feed"), "spark.sql.streaming.stateStore.providerClass"
    e = table(spark, sf_dir, "events")
    ads = e.select((F.col("event_id") % 500).alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("removed"), F.concat("event_type", F.floor("value").cast("int").cast("string")).alias("title"))
    ads.repartition(4).write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/in")
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feeds.run_state(spark, f"{root}/in", f"{root}/table", f"{root}/offsets", keep_days=36_500)
    finally:
        spark.conf.set(provider, before)
    return buckets.read(spark, f"{root}/table").select("id", "title", F.col("removed_at").cast("timestamp_ntz").alias("removed_at"))
