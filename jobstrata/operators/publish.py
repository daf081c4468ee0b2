"""Tables that readers see whole: a version is written beside the others, checked, and becomes current by one rename.

A version is a folder of Parquet files under `root/versions`; `root/CURRENT` names the one that is read. Runs and stamps are small
JSON rows. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """What was to be published isn't fit for it; nothing has changed."""


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside the path and renames it over it."""
    store, at = _store(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, last = _store(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = old
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(last.toUri() if last.toUri().getScheme() else store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(at, last, options)


def _read(spark: SparkSession, path: str) -> str | None:
    store, at = _store(spark, path)
    if not store.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0].strip()


def publish(table: DataFrame, root: str, floor: int = 0, stamp: str | None = None, share: float = 0.0) -> str:
    """SNK-09, SNK-20, SNK-24, SNK-26: writes `table` as a new version, and makes it current if it holds.

    Refused are fewer rows than `floor`, fewer than `share` of the current version's, and a stamp that isn't the current one's (a
    version without stamp takes any). The version that was current stays readable.
    """
    spark = table.sparkSession
    name = uuid.uuid4().hex
    path = f"{root}/versions/{name}"
    before = current_name(spark, root)
    if stamp is not None and before is not None:
        old = _read(spark, f"{root}/stamps/{before}")
        if old not in (None, stamp):
            raise Refused(f"the stamp is {stamp}, that of the current version {old}")
    table.write.parquet(path)
    n = spark.read.parquet(path).count()
    least = max(floor, share * current(spark, root).count() if before else 0)
    if n < least:
        raise Refused(f"{n} rows, {least:g} are needed")
    if stamp is not None:
        _write(spark, f"{root}/stamps/{name}", stamp)
    _write(spark, f"{root}/CURRENT", name)
    return name


def current_name(spark: SparkSession, root: str) -> str | None:
    return _read(spark, f"{root}/CURRENT")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that is current; one that another writer makes current meanwhile doesn't change what was opened."""
    name = current_name(spark, root)
    if name is None:
        raise FileNotFoundError(f"nothing was published in {root}")
    return spark.read.parquet(f"{root}/versions/{name}")


def recorded(spark: SparkSession, root: str, run: DataFrame) -> None:
    """SNK-06: appends run records. A retried task leaves no second copy: Spark's committer moves whole files."""
    run.write.mode("append").parquet(f"{root}/runs")


# --- rules of writing, as transformations ---


def inserted(stored: DataFrame, leads: DataFrame, key: list[str]) -> DataFrame:
    """SNK-14: stored rows, and leads whose key is new; of leads with one key one row."""
    return stored.unionByName(leads.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))


def improved(stored: DataFrame, found: DataFrame, key: list[str], rank: str) -> DataFrame:
    """SNK-15, SNK-16: a found row replaces a stored one only if it ranks better (a smaller number); others keep their place."""
    columns = [c for c in stored.columns if c not in key]
    a = stored.select(*key, F.struct(*columns).alias("__old"))
    b = found.select(*key, F.struct(*columns).alias("__new"))
    joined = a.join(b, key, "full")
    wins = F.col("__old").isNull() | (F.col("__new").isNotNull() & (F.col(f"__new.{rank}") < F.col(f"__old.{rank}")))
    return joined.select(*key, *[F.when(wins, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in columns])


def pruned(state: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """SNK-08: state whose parent still lives."""
    return state.join(parents.select(*key).distinct(), key, "left_semi")


def latest_versions(derived: DataFrame, version: int, key: list[str]) -> DataFrame:
    """SNK-19: derived rows without those of older versions, where the key has rows of the current one."""
    now = derived.where(F.col("version") == version).select(*key).distinct()
    return derived.where(F.col("version") >= version).unionByName(derived.where(F.col("version") < version).join(now, key, "left_anti"))


def protected(stored: DataFrame, incoming: DataFrame, key: list[str], by_hand: str, purge: str) -> DataFrame:
    """SNK-18: incoming rows win except over rows written by hand; stored rows that `purge` describes (and no hand wrote) go."""
    hand = F.expr(by_hand)
    kept = stored.where(hand | ~F.coalesce(F.expr(purge), F.lit(False)))
    new = incoming.join(kept.where(hand).select(*key), key, "left_anti")
    return new.unionByName(kept.join(new.select(*key), key, "left_anti"))


def cells(sheet: DataFrame, corrections: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """SNK-23: the sheet with the corrected cells (key, column, value); of several for one cell the last by seq. Other cells stay."""
    last = corrections.groupBy(*key).agg(*[F.max_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, F.col("seq"))).alias(f"__{c}") for c in columns])
    return sheet.join(last, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in sheet.columns])


def redrawn(sheet: DataFrame, drawn: DataFrame, live: DataFrame, key: list[str], filled: str) -> DataFrame:
    """SNK-22: the sheet after a new draw: filled rows stay, drawn ones are added blank. Refused if a filled row's posting is gone."""
    kept = sheet.where(filled)
    lost = kept.join(live.select(*key), key, "left_anti").limit(1).collect()
    if lost:
        raise Refused(f"a labelled row has no posting: {[lost[0][k] for k in key]}")
    return kept.unionByName(drawn.join(kept.select(*key), key, "left_anti"), allowMissingColumns=True)
