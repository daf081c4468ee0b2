"""The feed as state: equal to the batch form, bounded, replayed; buckets with two writers."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobstrata.operators import buckets
from jobstrata.operators.publish import Refused
from jobstrata.streaming import feeds

DAY = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def put(folder, name, ads):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"id": i, "ts": t.isoformat(), "removed": r, "title": x}) for i, t, r, x in ads]
    (folder / f"{name}.json").write_text("\n".join(lines))


def table(spark, root):
    return {(r["id"], r["title"], r["removed_at"]) for r in buckets.read(spark, root).collect()}


def test_state_equals_the_batch_form_and_replays(rocks, tmp_path):
    dice, feed, root, check = random.Random(6), tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "c")
    every = []
    for k in range(3):
        ads = [(dice.randrange(25), DAY + timedelta(minutes=dice.randrange(50) + 20 * k), dice.random() < 0.3, dice.choice(["a", "b", None, "c"])) for _ in range(60)]
        ads += every[-10:]  # reads overlap
        every += ads
        put(feed, f"f{k}", ads)
        feeds.run_state(rocks, str(feed), root, check, late="10 days")
        df = rocks.createDataFrame(every, feeds.AD)
        want = {(r["id"], r["title"], r["removed_at"]) for r in feeds.state_of(df).collect()}
        assert table(rocks, root) == want
        assert buckets.manifest(rocks, root)["note"]["cursor"] == max(int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for _, t, _, _ in every)
    before = buckets.manifest(rocks, root)
    put(feed, "again", every[:50])  # a replay changes no state and so writes no bucket
    feeds.run_state(rocks, str(feed), root, check, late="10 days")
    after = buckets.manifest(rocks, root)
    assert after["paths"] == before["paths"] and after["note"]["cursor"] == before["note"]["cursor"]
    fresh = str(tmp_path / "fresh")  # from the start, with a new checkpoint
    feeds.run_state(rocks, str(feed), fresh, str(tmp_path / "c2"), late="10 days")
    assert table(rocks, fresh) == table(rocks, root)


def test_old_tombstones_leave_the_state(rocks, tmp_path):
    feed, root, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "c")
    put(feed, "a", [(1, DAY, False, "x"), (1, DAY + timedelta(hours=1), True, None), (2, DAY, False, "y")])
    feeds.run_state(rocks, str(feed), root, check, keep_days=2)
    assert {r[0] for r in table(rocks, root)} == {1, 2}
    put(feed, "b", [(3, DAY + timedelta(days=9), False, "z")])
    feeds.run_state(rocks, str(feed), root, check, keep_days=2)
    put(feed, "c", [(3, DAY + timedelta(days=9), False, "z")])
    feeds.run_state(rocks, str(feed), root, check, keep_days=2)
    assert {r[0] for r in table(rocks, root)} == {2, 3}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(200).select("id", F.lit("a").alias("v"))
    buckets.upsert(rows, root, ["id"], n=8, note="first")
    before = buckets.manifest(spark, root)
    assert len(before["paths"]) == 8 and before["note"] == "first"
    old = buckets.read(spark, root)
    buckets.upsert(spark.createDataFrame([(5, "b"), (500, "b")], "id long, v string"), root, ["id"])
    after = buckets.manifest(spark, root)
    changed = {b for b in after["paths"] if after["paths"][b] != before["paths"][b]}
    assert 1 <= len(changed) <= 2
    got = {r["id"]: r["v"] for r in buckets.read(spark, root).collect()}
    assert got == {i: "a" for i in range(200)} | {5: "b", 500: "b"} and old.count() == 200
    gone = lambda o, new: o.join(new.select("id"), "id", "left_anti")
    buckets.upsert(rows, root, ["id"], gone)
    assert {r["id"] for r in buckets.read(spark, root).collect()} == {500}
    assert buckets.upsert(rows.limit(0), root, ["id"]) == 3 and buckets.vacuumed(spark, root, 1) == 2
    assert buckets.read(spark, root).count() == 1 and buckets.version(spark, root) == 3


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(20).select("id", F.lit("a").alias("v"))
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, root)
    base = buckets.upsert(rows, root, ["id"], n=4)
    buckets.upsert(rows.where("id < 3").withColumn("v", F.lit("one")), root, ["id"], based_on=base)
    folders = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    with pytest.raises(Refused):
        buckets.upsert(rows.where("id < 9").withColumn("v", F.lit("two")), root, ["id"], based_on=base)
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == folders and buckets.version(spark, root) == base + 1
    assert not [p for p in (tmp_path / "t" / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert {r["v"] for r in buckets.read(spark, root).where("id < 3").collect()} == {"one"}
