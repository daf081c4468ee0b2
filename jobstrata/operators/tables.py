"""Intermediate tables in the folder that executors share, and columns that Spark must not compute anew."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. On a local master a temporary one is set where none is; elsewhere that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application's own in the shared folder, never given twice."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Results that were not saved can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def where_known(df: DataFrame, condition: Column) -> DataFrame:
    """df where the condition holds, evaluated on the columns as computed: not pushed below them, which would compute them anew.

    Spark moves filters, its own ones for explode included, below the expressions that they use, and so evaluates costly ones twice or
    more. A number that only the run gives keeps them where they stand.
    """
    return df.withColumn("__n", F.monotonically_increasing_id()).where(condition & (F.col("__n") >= 0)).drop("__n")


def computed(df: DataFrame) -> DataFrame:
    """df, the columns of which nothing above computes anew."""
    return where_known(df, F.lit(True))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, about: DataFrame | None = None) -> DataFrame:
    """df, written in the shared folder, with position (from 0, of each row in its group by order, nulls first), n_group, and the columns of
    about, which has one row for each group.

    Rows are dealt out by range of group and order, so a hot group is many tasks' work; what is summed over whole groups is
    one row for each group and task. Rows that are the same in group and order stand in any order among themselves.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__n", F.monotonically_increasing_id())
    rows = stored(placed, name).withColumn("__part", F.shiftright("__n", 33))
    own = rows.groupBy(*group, "__part").agg(F.min("__n").alias("__least"), F.count(F.lit(1)).alias("__count"))
    every = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__count").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = own.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), (before - F.col("__least")).alias("__shift"), F.sum("__count").over(every).alias("n_group"))
    alike = lambda a, b: reduce(and_, [F.col(a.format(i, g)).eqNullSafe(F.col(b.format(i, g))) for i, g in enumerate(group)])
    more = []
    if about is not None:  # joined to the starts, not to the rows: a hot group has one start for each task
        more = [c for c in about.columns if c not in group]
        starts = starts.join(about.select(*more, *[F.col(g).alias(f"__a{i}") for i, g in enumerate(group)]), alike("__g{0}", "__a{0}"))
    found = rows.join(starts, (F.col("__part") == F.col("__p")) & alike("{1}", "__g{0}"))
    return found.select(*df.columns, (F.col("__n") + F.col("__shift")).alias("position"), "n_group", *more)
