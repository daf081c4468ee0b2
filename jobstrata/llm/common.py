"""What the operators of this package share: reading, scratch tables, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import new_path, numbered, stored, where_known  # noqa: F401

#: ASCII white space; Python's bytes.split() splits at just these.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def lean(spark: SparkSession, rows: int = 3_000) -> Iterator[None]:
    """Arrow batches of few rows for the queries that run inside: rows here hold whole texts or sets, and two workers share an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class WordHashes(dict):
    """64-bit hash of each word's bytes, kept for the words met last (memory is bounded)."""

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each word's bytes, as WordHashes gives it; in texts with many different words to hash is faster than to look up."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), ">u8").astype(np.uint64)


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; an odd number has an inverse there."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return kept[0][:n], kept[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, length: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of `length` words, in linear time whatever the length; empty if there are too few words."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mixed((total[length:] - total[: n - length + 1]) * down[: n - length + 1])


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def utf8(value: pa.Scalar | str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
