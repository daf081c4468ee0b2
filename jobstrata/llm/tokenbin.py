"""Token ids in a binary format of directly addressable codes.

A block holds whole documents, 2**18 tokens or one document at least. Each id is cut into chunks of eight bits: level 0 has the lowest
chunk of every token, level k + 1 the next chunk of those tokens whose bit in the bitmap of level k says that it goes on.
A rank directory has the number of set bits before each 512th bit, so any token is read with one look at each level and no block is
decoded. Blocks are rows of a Parquet table in the order of their documents' ids, so any store that Spark writes will do.

A null text is empty, and so is one without tokens: both have the end id alone. A null doc_id sorts first. Repeated rows are kept, each
with its tokens. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_bytes

END = 2
BLOCK = 1 << 18
RANK = 512
BLOCKS = "part int, seq int, n_tokens long, doc_ids array<bigint>, ends array<bigint>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


# --- the code of one block ---


def encoded(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The chunks, bitmaps and rank directories of the levels of an array of ids."""
    chunks, bitmaps, ranks, left = [], [], [], ids.astype(np.uint32)
    while True:
        more = left > 255
        packed = np.packbits(more, bitorder="little")
        chunks.append((left & np.uint32(255)).astype(np.uint8).tobytes())
        bitmaps.append(packed.tobytes())
        before = np.zeros(len(packed) + 1, np.uint32)
        np.cumsum(_ONES[packed], out=before[1:])
        ranks.append(before[: -1 : RANK // 8].tobytes())
        left = left[more] >> np.uint32(8)
        if not len(left):
            return chunks, bitmaps, ranks


class Block:
    """Random access to the ids of a block."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(x, np.uint8) for x in chunks]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, np.uint32) for x in ranks]

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before bit i."""
        bits, k = self.bitmaps[level], i // RANK
        if k >= len(self.ranks[level]):
            k = len(self.ranks[level]) - 1
        if k < 0:
            return 0
        whole = _ONES[bits[k * (RANK // 8) : i // 8]].sum(dtype=np.int64)
        rest = bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0
        return int(self.ranks[level][k]) + int(whole) + rest

    def token(self, i: int) -> int:
        """The id at i, from one chunk of each level that it has."""
        value, level = 0, 0
        while True:
            value |= int(self.chunks[level][i]) << 8 * level
            if not self.bitmaps[level][i // 8] >> i % 8 & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start up to end, without those before them."""
        spot, out, level = np.arange(end - start), np.zeros(end - start, np.uint32), 0
        while len(spot):
            out[spot] |= self.chunks[level][start:end].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(self.bitmaps[level][start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            spot = spot[bits]
            if len(spot):
                start = self._rank(level, start)
                end, level = start + len(spot), level + 1
        return out


# --- tokens of a text ---


class WordIds(dict):
    """Packed ids of each chunk of text between white space; the tokenizer's tokens never span any (`by_words` tells from its definition).

    Only chunks not met before go through the tokenizer. Those of letters and closing marks share the ids of their lower-cased
    letters; such runs of letters go through together, and their ids are told apart by the mark that ends a word.
    Memory is bounded: when it is full, all is forgotten.
    """

    MARKS = ".,;:!?%*&#$|"

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.parts = Tokenizer.from_file(path), limit, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 512):
            some = runs[i : i + 512]
            packed = self._encode([" ".join(some)])[0]
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(packed, "<u4")]) + 4).tolist()
            if len(cuts) == len(some):
                self.parts.update(zip(some, (packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                self.parts.update(zip(some, self._encode(some), strict=True))

    def learn(self, texts: list[list[bytes]]) -> None:
        every = set(chain.from_iterable(texts))
        new = [w for w in every if w not in self]
        if len(self) + len(new) > self.limit:
            self.clear(), self.parts.clear()
            new = list(every)
        plain, other = [], []
        for word in new:
            text = word.decode("utf-8", "replace")
            core = text.rstrip(self.MARKS)
            low = core.lower()
            if low.isalpha() and len(low) == len(core) and (core.isascii() or max(core) < "\u0250" and is_normalized("NFC", core)):
                plain.append((word, low, text[len(core) :]))
            else:
                other.append((word, text))
        self._letters(list({low for _, low, _ in plain if low not in self.parts}))
        marks = list({m for *_, m in plain if m and m not in self.parts})
        self.parts.update(zip(marks, self._encode(marks), strict=True))
        self.parts[""] = b""
        for word, low, m in plain:
            self[word] = self.parts[low] + self.parts[m]
        self.update(zip([w for w, _ in other], self._encode([t for _, t in other]), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [x.split() for x in texts]
        self.learn(split)
        return [np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4") for words in split]


class TextIds:
    """The ids of whole texts, straight from the tokenizer: for any definition."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 64):
            some = [x.decode("utf-8", "replace") for x in texts[i : i + 64]]
            out += [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out


#: What a definition must say for its words to be looked up alone: white space separates, case doesn't matter, words end with a suffix.
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    "</w>",
)


def by_words(path: str) -> bool:
    """Whether the tokenizer's own definition says what WordIds takes for granted; added tokens must hold no white space and be spelt with marks."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    added = all(re.fullmatch(r"[^\s\w]\S*[^\s\w]", t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in own.get("added_tokens") or [])
    return added and (own.get("normalizer"), steps[0], own["model"].get("end_of_word_suffix")) == WORDS


_KNOWN: dict[str, WordIds | TextIds] = {}


def known_ids(path: str) -> WordIds | TextIds:
    """The process's own ids: a Python worker keeps them from task to task."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path) if by_words(path) else TextIds(path)
    return _KNOWN[path]


# --- tables ---


def blocks(docs: DataFrame, tokenizer: str, end: int = END, size: int = BLOCK) -> DataFrame:
    """The blocks of docs in ascending doc_id order. tokenizer: the file's path on every executor."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, part, seq = known_ids(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        kept: list[np.ndarray] = []
        total = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in kept])
            chunks, bitmaps, ranks = encoded(np.concatenate(kept))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), *[pa.array([x], pa.list_(pa.binary())) for x in (chunks, bitmaps, ranks)]],
                ["part", "seq", "n_tokens", "doc_ids", "ends", "chunks", "bitmaps", "ranks"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, own in zip(some["doc_id"].to_pylist(), known.encode(text_bytes(some["text"])), strict=True):
                    doc_ids.append(doc_id)
                    kept.append(np.append(own, np.uint32(end)))
                    total += len(kept[-1])
                    if total >= size:
                        yield block()
                        seq, total = seq + 1, 0
                        doc_ids.clear(), kept.clear()
        if kept:
            yield block()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(encode, BLOCKS)


def written(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """The blocks of docs, written in the shared folder, as they read back."""
    return stored(blocks(docs, tokenizer, end), "tokens")


def offsets(table: DataFrame) -> DataFrame:
    """part, seq and before: ids of all blocks before this one. Of each part of the table one row meets in the last window."""
    own = table.select("part", "seq", "n_tokens")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("lead"))
    return own.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("own")).join(parts, "part").select("part", "seq", (F.col("lead") + F.col("own")).alias("before"))


def documents(table: DataFrame) -> DataFrame:
    """part, seq, doc_id, local (its first token in the block), n_tokens and ids_crc32, read by random access document for document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, start, out = Block(row["chunks"], row["bitmaps"], row["ranks"]), 0, []
                for end in row["ends"]:
                    out.append((start, end - start, zlib.crc32(block.tokens(start, end).astype("<u4").tobytes())))
                    start = end
                n = len(out)
                local, size, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), *[pa.array(x, pa.int64()) for x in (local, size, crc)]], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    return table.mapInArrow(read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")


def tokens_at(table: DataFrame, positions: list[int]) -> DataFrame:
    """position and token of places among the ids of all documents. Only the blocks that hold one are read, and of these only the chunks,
    bitmaps and directories of the levels that a token has; no block is decoded. Places outside give no row. A stated, short list."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(p),) for p in positions], "position long").distinct()
    # where each block starts comes from n_tokens alone, a column of its own in the file; the join keeps the blocks that are asked for
    spots = table.select("part", "seq", "n_tokens").join(offsets(table), ["part", "seq"])
    where = spots.join(F.broadcast(asked), (F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n_tokens")))
    wanted = where.groupBy("part", "seq").agg(F.collect_list(F.struct("position", (F.col("position") - F.col("before")).alias("at"))).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(*(batch[c][k].as_py() for c in ("chunks", "bitmaps", "ranks")))
                for one in batch["asked"][k].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([one["position"]]), pa.array([block.token(one["at"])], pa.int64())], ["position", "token"])

    found = table.select("part", "seq", "chunks", "bitmaps", "ranks").join(F.broadcast(wanted), ["part", "seq"])
    return found.select("chunks", "bitmaps", "ranks", "asked").mapInArrow(read, "position long, token long")


def digest(table: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document."""
    return documents(table).join(offsets(table), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
