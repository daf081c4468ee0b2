"""Substring dedup by level-wise doubling: runs of words repeated at one length alone are extended to twice that length.

The first level has runs of half the window (6 of 13 words). A window is represented by the one run in it whose hash is smallest,
the same in every copy of the window, so a fifth of all runs is shuffled and no repeated window is missed. Only windows whose
run comes in two documents go on to the second level, the window itself (twice 6 words, and the odd one), where it is told in which
documents it starts. Levels of 26, 52, ... words follow in `passages`, until nothing survives. Hashes of a level above the
first have 64 bits and 32 more.

At each level the rows that could match are sorted by hash within their partitions and read as a stream that holds one row, so
memory doesn't grow with a hash that many documents share; a document adds one row to a hash, however often it has it. Exact copies
of a text go no further than the first level: all their windows start in the copy with the smallest id.

Null and empty texts have no words. Rows with a null doc_id are returned as they are and compared with nothing. Rows with one doc_id
count as one document: they are never removed for each other, but each for smaller ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, WordHashes, long_array, stored, text_bytes, windows

WINDOW = 13


def _spots(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window the place of the run that represents it, the leftmost of the smallest."""
    width = window - seed + 1
    return np.lib.stride_tricks.sliding_window_view(windows(hashes, seed), width).argmin(axis=1) + np.arange(len(hashes) - window + 1)


def keys(docs: DataFrame) -> DataFrame:
    """doc_id and whether the document is a copy: one with a smaller id has the same words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashlib.blake2b(b" ".join(x.split()), digest_size=16).digest() for x in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own, pa.binary())], ["doc_id", "key"])

    own = docs.mapInArrow(digest, "doc_id long, key binary")
    first = own.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return own.join(first, "key").where("doc_id > first").select("doc_id").distinct().withColumn("copy", F.lit(True))


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """h and doc_id: each run that represents a window, once a document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some, found, owners = batch.slice(at, 1000), [], []
                for doc_id, text in zip(some["doc_id"].to_pylist(), text_bytes(some["text"]), strict=True):
                    hashes = known.of(text.split())
                    if len(hashes) >= window:
                        own = np.unique(windows(hashes, seed)[np.unique(_spots(hashes, window, seed))])
                        found.append(own)
                        owners.append(np.full(len(own), doc_id, np.int64))
                if found:
                    yield pa.RecordBatch.from_arrays([long_array(np.concatenate(found)), pa.array(np.concatenate(owners))], ["h", "doc_id"])

    return docs.mapInArrow(emit, "h long, doc_id long")


def met_again(rows: DataFrame, by: list[str], later: bool) -> DataFrame:
    """Of rows (by, doc_id) those whose `by` comes in another row too; with later, only where one has a smaller doc_id."""
    names = [*by, "doc_id"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None  # the last row, of which it isn't known yet whether it is the only one; the first id of its run
        flag = False
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in (batch[n] for n in names)]
            if held is not None:
                own = [np.concatenate([h, c]) for h, c in zip(held, own, strict=True)]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in own[:-1]])
            before = np.append(flag if held is not None else False, same)
            starts = np.flatnonzero(~before)
            run = np.cumsum(~before) - 1
            firsts = own[-1][starts] if len(starts) else np.empty(0, np.int64)
            least = np.where(run >= 0, firsts[np.maximum(run, 0)] if len(firsts) else 0, first if first is not None else 0)
            good = own[-1] > least if later else before | np.append(same, False)
            n = len(before) - 1
            if n and good[:n].any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:n][good[:n]]) for c in own], schema=batch.schema)
            held, flag, first = [c[-1:] for c in own], bool(before[-1]), least[-1]
        if held is not None and (held[-1][0] > first if later else flag):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=batch.schema)

    return rows.select(*names).repartition(by[0]).sortWithinPartitions(*names).mapInArrow(keep, rows.select(*names).schema)


def grown(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """h, g and doc_id: windows of docs that survive, given in `found` the hashes of the level before; once a document.

    A window of less than twice the seed's length needs its representing run, any other the runs at both its halves.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, parts, owners = batch.slice(at, 500), [], []
                for doc_id, text, found in zip(some["doc_id"].to_pylist(), text_bytes(some["text"]), some["found"], strict=True):
                    hashes = known.of(text.split())
                    if len(hashes) < window or not len(found.values):
                        continue
                    level = np.isin(windows(hashes, seed), found.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    good = level[_spots(hashes, window, seed)] if window != 2 * seed else level[: len(hashes) - window + 1] & level[seed:]
                    h, where = np.unique(windows(hashes, window)[good], return_index=True)
                    parts.append((h, (windows(hashes, window, BASES[1])[good][where] >> np.uint64(33)).astype(np.int32)))
                    owners.append(np.full(len(h), doc_id, np.int64))
                if parts:
                    h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([long_array(h), pa.array(g), pa.array(np.concatenate(owners))], ["h", "g", "doc_id"])

    return docs.select("doc_id", "text", "found").mapInArrow(emit, "h long, g int, doc_id long")


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """The hashes of each document as a list: at most as many as it has words."""
    return rows.groupBy("doc_id").agg(F.collect_list("h").alias(name))


def _survivors(docs: DataFrame, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows h, g, doc_id of windows whose seed comes in two documents, and the copies, which have no such rows."""
    copies = keys(docs)
    first = _lists(met_again(seeds(docs, window, seed), ["h"], later=False), "found")
    own = stored(first.join(copies, "doc_id", "full"), "seeds")
    joined = docs.join(own.where("copy IS NULL").select("doc_id", "found"), "doc_id")
    return grown(joined, window, seed), own.where("copy").select("doc_id", "copy")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by spaces) of every row.

    Removed is each word covered by a window whose words also start in a document with a smaller doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    some = docs.where(F.col("doc_id").isNotNull())
    rows, copies = _survivors(some, window, window // 2)
    gone = _lists(met_again(rows, ["h", "g"], later=True), "gone").join(copies, "doc_id", "full")
    both = docs.join(stored(gone, "windows"), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, out = batch.slice(at, 500), []
                for text, copy, found in zip(text_bytes(some["text"]), some["copy"].to_pylist(), some["gone"], strict=True):
                    words = text.split()
                    n = len(words)
                    if n < window or not (copy or found.is_valid):
                        out.append((n, 0, b" ".join(words)))
                    elif copy:
                        out.append((n, n, b""))
                    else:
                        hit = np.isin(windows(known.of(words), window), found.values.to_numpy(zero_copy_only=False).view(np.uint64))
                        steps = np.zeros(n + 1, np.int32)
                        starts = np.flatnonzero(hit)
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, starts + window, -1)
                        left = np.cumsum(steps[:n]) == 0
                        out.append((n, int(n - left.sum()), b" ".join([w for w, k in zip(words, left.tolist(), strict=True) if k])))
                n, m, kept = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "copy", "gone").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and longest: the last level (window, twice the window, ...) at which a document that isn't a copy shares a run of words.

    The levels go on until no candidates survive; a level costs one pass over the documents that are left.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    rows, _ = _survivors(docs, window, window // 2)
    length, out = window, None
    while True:
        alive = stored(_lists(met_again(rows, ["h", "g"], later=False), "found"), f"level{length}")
        level = alive.select("doc_id", F.lit(length).alias("longest"))
        out = level if out is None else out.unionByName(level)
        if alive.isEmpty():
            return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        rows, length = grown(docs.join(alive, "doc_id"), 2 * length, length), 2 * length
