"""A keyed table in buckets, changed by small upserts: only buckets that a change touches are written anew, and a version is one file of a log.

The log has a file for each version, numbered from 0: which folder holds each bucket, and a note. A version is committed by a rename that
fails if the number is taken, so of two writers that started from one version the second is refused and nothing of it stays. Readers
open the last version; its files are never changed. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .publish import Refused, _read, _store

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _log(root: str, version: int) -> str:
    return f"{root}/log/{version:020d}.json"


def version(spark: SparkSession, root: str) -> int:
    """The number of the last version; -1 if there is none."""
    store, at = _store(spark, f"{root}/log")
    if not store.exists(at):
        return -1
    names = [f.getPath().getName() for f in store.listStatus(at)]
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """What a version (the last one) says: version, n (buckets), paths by bucket, and note."""
    number = version(spark, root) if number is None else number
    if number < 0:
        return {"version": -1, "n": None, "paths": {}, "note": None}
    return json.loads(_read(spark, _log(root, number)))


def bucket_of(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of a version (the last one)."""
    told = manifest(spark, root, number)
    if told["version"] < 0:
        raise FileNotFoundError(f"no version in {root}")
    return _rows(spark, told["paths"].values(), told["schema"])


def _rows(spark: SparkSession, paths, schema: dict) -> DataFrame:
    paths, fields = sorted(paths), StructType.fromJson(schema)
    return spark.read.schema(fields).parquet(*paths) if paths else spark.createDataFrame([], fields)


def replaced(key: list[str]) -> Merge:
    """Changed rows take the place of those with their key."""
    return lambda old, new: old.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert(changes: DataFrame, root: str, key: list[str], merge: Merge | None = None, n: int = 64, note: object = None, based_on: int | None = None) -> int:
    """SNK-02, SNK-11: applies changes to the table and commits a version with the note; its number is returned.

    merge: the rows of a bucket that were there and those that come -> the rows that are there then; a key never leaves its bucket. The
    numbers of the touched buckets, n at most, come to the driver. based_on: the version that the changes were made from (the last one
    now); refused if another came since. The number of buckets is that of the first version.
    """
    spark = changes.sparkSession
    told = manifest(spark, root, based_on)
    n, schema = told["n"] or n, told.get("schema") or changes.schema.jsonValue()
    columns = changes.columns
    folder = f"{root}/data/{uuid.uuid4().hex}"
    marked = changes.withColumn("__b", bucket_of(key, n))
    touched = sorted(r["__b"] for r in marked.select("__b").distinct().collect())
    paths = dict(told["paths"])
    if touched:
        old = _rows(spark, [paths[str(b)] for b in touched if str(b) in paths], schema)
        merged = (merge or replaced(key))(old.select(*columns), changes)
        merged.select(*columns).withColumn("__b", bucket_of(key, n)).repartition("__b").write.partitionBy("__b").parquet(folder)
        store, at = _store(spark, folder)
        left = {f.getPath().getName() for f in store.listStatus(at)}
        for b in touched:
            name = f"__b={b}"
            if name in left:
                paths[str(b)] = f"{folder}/{name}"
            else:  # no row is left in it
                paths.pop(str(b), None)
    number = told["version"] + 1
    try:
        _commit(spark, root, number, {"version": number, "n": n, "schema": schema, "paths": paths, "note": note})
    except Refused:
        store, at = _store(spark, folder)
        store.delete(at, True)
        raise
    return number


def _commit(spark: SparkSession, root: str, number: int, told: dict) -> None:
    """Writes the version's file beside the log and renames it into its place, if that is free."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store, last = _store(spark, _log(root, number))
    store.mkdirs(last.getParent())
    _, temporary = _store(spark, f"{root}/log/.{uuid.uuid4().hex}")
    out = store.create(temporary, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(store.makeQualified(temporary), store.makeQualified(last), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        store.delete(temporary, False)
        if store.exists(last):
            raise Refused(f"version {number} was committed by another writer") from e
        raise


def vacuumed(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes folders that none of the last `keep` versions reads, and the log's files before those; the number of folders is returned."""
    last = version(spark, root)
    kept = {p.rsplit("/", 2)[1] for v in range(max(0, last - keep + 1), last + 1) for p in manifest(spark, root, v)["paths"].values()}
    store, at = _store(spark, f"{root}/data")
    gone = [f.getPath() for f in store.listStatus(at) if f.getPath().getName() not in kept] if store.exists(at) else []
    for path in gone:
        store.delete(path, True)
    for f in store.listStatus(_store(spark, f"{root}/log")[1]):
        name = f.getPath().getName()
        if name.endswith(".json") and int(name[:-5]) <= last - keep:
            store.delete(f.getPath(), False)
    return len(gone)
