"""Bounded samples of labelled rows, and what the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out and never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(labels: DataFrame, label: str, each: int) -> DataFrame:
    """doc_id, y and weight of `each` rows at most of either label outside fold 0, chosen by the hash of their ids.

    weight brings the classes back to their shares among all labelled rows. Rows without a label or an id are left out; of one
    id's rows with different labels the larger label counts.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).withColumn("weight", F.lit(counts.get(y, 0) / max(1, min(each, counts.get(y, 0))))) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


#: Bytes of whole texts that may come to the driver to fit on; beyond, fewer rows are taken in the sample's order, and none in part.
BYTES = 64 << 20


def texts(docs: DataFrame, chosen: DataFrame, most: int = BYTES) -> list:
    """The rows of docs that were chosen, by doc_id; `chosen` is a bounded sample, so it is broadcast. Texts of `most` bytes at most come to the driver."""
    found = docs.join(F.broadcast(chosen), "doc_id").withColumn("__b", F.coalesce(F.octet_length("text"), F.lit(0)))
    some = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    sizes = stored(found, "sample")
    total = sizes.agg(F.sum("__b")).first()[0] or 0
    if total > most:  # a window over the sample's rows, which are bounded
        sizes = sizes.withColumn("__s", F.sum("__b").over(some)).where(F.col("__s") <= most).drop("__s")
    return sizes.drop("__b").orderBy("doc_id", "text").collect()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, theta: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        theta -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
