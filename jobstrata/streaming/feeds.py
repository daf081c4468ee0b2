"""Delta feeds and keyed state as Structured Streaming, with the batch forms that they must equal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import buckets
from ..operators.merge import newest

KEY = ["id"]
AD = "id long, ts timestamp, removed boolean, title string"


def state_of(ads: DataFrame) -> DataFrame:
    """The postings after all ads: each id's last title, and when it was removed if its last ad says so."""
    last = newest(ads, KEY, [F.desc("ts"), F.desc("removed"), F.desc("title")])
    titles = newest(ads.where("NOT removed"), KEY, [F.desc("ts"), F.desc("title")]).select("id", "title")
    return last.select("id", "ts", "removed").join(titles, KEY, "left").select("id", "title", F.when(F.col("removed"), F.col("ts")).alias("removed_at"))


def run_feed(spark: SparkSession, source: str, table: str, checkpoint: str) -> None:
    """Applies the feed files of `source` to `table`: the log of ads is appended once a batch, a retried batch overwrites its own part.

    Overlapping reads and late ads change nothing that `state_of` gives; offsets advance only if the batch is written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["id", "ts", "removed", "title"]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(AD).json(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


LISTED = "id long, title string, removed_at timestamp, ts timestamp, dropped boolean"


class Posting(StatefulProcessor):
    """The state of one id: its last ad by (ts, removed, title), and its last title by (ts, title) of ads that don't remove it.

    Ads come in any order and any number of times; what changes nothing gives no row. A removal sets a timer `keep` after its ts: if the
    posting is still removed then, its state is dropped, and a row says so. An ad that comes even later starts anew, as a feed that
    shows an id again does.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, removed boolean, title string")
        self.named = handle.getValueState("named", "ts long, title string")

    @staticmethod
    def _order(ad: tuple) -> tuple:
        """An ad's place; a null title is before all others."""
        ts, removed, title = ad
        return ts, removed, title is not None, title or ""

    def _row(self, key: tuple, dropped: bool) -> pd.DataFrame:
        ts, removed, _ = self.last.get()
        title = self.named.get()[1] if self.named.exists() else None
        at = pd.Timestamp(ts, unit="us")
        return pd.DataFrame({"id": [key[0]], "title": [title], "removed_at": pd.to_datetime(pd.Series([at if removed else None])), "ts": [at], "dropped": [dropped]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        named = tuple(self.named.get()) if self.named.exists() else None
        before = (last, named)
        for batch in rows:
            for ts, removed, title in zip(batch["us"], batch["removed"], batch["title"], strict=True):
                ad = (int(ts), bool(removed), None if title is None or title != title else title)
                if last is None or self._order(ad) > self._order(last):
                    last = ad
                if not ad[1] and (named is None or self._order((ad[0], False, ad[2])) > self._order((named[0], False, named[1]))):
                    named = (ad[0], ad[2])
        if (last, named) == before:
            return
        self.last.update(last)
        if named is not None:
            self.named.update(named)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last[1]:
            self.handle.registerTimer(last[0] // 1000 + self.keep)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1]:
            row = self._row(key, True)
            self.last.clear()
            self.named.clear()
            yield row

    def close(self) -> None:
        pass


def postings_state(ads: DataFrame, keep_days: int, late: str = "1 hour") -> DataFrame:
    """STR-05, SNK-13: a stream of ads (AD) as the changes of postings (LISTED): a row whenever an id's state changes, and one with `dropped` when its
    tombstone is older than `keep_days` by the watermark. State is two small values an id that is listed or was removed lately, in
    RocksDB; nothing else of the feed is kept. Needs spark.sql.streaming.stateStore.providerClass to name the RocksDB provider."""
    timed = ads.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("id").transformWithStateInPandas(Posting(keep_days * 86_400_000), LISTED, "Update", "EventTime")


def run_state(spark: SparkSession, source: str, root: str, checkpoint: str, keep_days: int = 90, late: str = "1 hour", n: int = 16) -> None:
    """STR-01, 02, 03, 08, SNK-13, SNK-27: the feed files of `source` kept as a table of postings in buckets at `root`.

    A batch's changes, its number and the cursor (the last ts seen) are committed as one version. A batch that is run again after its
    version was committed changes nothing; one that fails leaves neither rows nor cursor. Overlapping reads change no state, and so write no bucket.
    """

    def apply(batch: DataFrame, number: int) -> None:
        told = buckets.manifest(spark, root)
        note = told["note"] or {"batch": -1, "cursor": None}
        if note["batch"] >= number:
            return
        own = batch.persist()
        latest = own.agg(F.max(F.unix_micros("ts"))).first()[0]
        cursor = max([x for x in (latest, note["cursor"]) if x is not None], default=None)
        # of an id that changed and was dropped in one batch the drop is last
        last = newest(own, KEY, [F.desc("dropped")])
        merge = lambda old, new: buckets.replaced(KEY)(old, new).where("NOT dropped")
        buckets.upsert(last, root, KEY, merge, n, {"batch": number, "cursor": cursor}, told["version"])
        own.unpersist()

    stream = postings_state(spark.readStream.schema(AD).json(source), keep_days, late)
    stream.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, postings = state.get if state.exists else (0, None)
    rows = pd.concat(list(batches)).sort_values(["polled_at", "poll_id"])
    for r in rows.itertuples():
        failures = 0 if r.ok else failures + 1
        postings = int(r.postings) if r.ok else postings
    state.update((failures, postings))
    yield pd.DataFrame({"board": [key[0]], "failures": [failures], "postings": pd.array([postings], dtype="Int64")})


def failure_streaks(polls: DataFrame) -> DataFrame:
    """A stream of polls (board, poll_id, polled_at, ok, postings) as each board's state after every batch: failures in a row, last postings."""
    return polls.groupBy("board").applyInPandasWithState(_streak, "board string, failures long, postings long", "failures long, postings long", "update", GroupStateTimeout.NoTimeout)
