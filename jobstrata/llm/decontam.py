"""Benchmark decontamination: the windows of the benchmark's words are broadcast by their hash and looked up in each document.

A window is ten consecutive words of an item; an item of fewer words, but not none, is one window of its own length. Words
are runs of ASCII letters and digits and of all characters above ASCII, with A-Z lower-cased. A hit by hash is verified on the
words themselves. Only DataFrame functions are used.

A hit is a place and the number of a window; which items have a window is looked up last, once for each set of windows that documents
have, so a window that many items share and a document that repeats it cost no product of both.

Nulls and empty texts have no words: no hits, and an item without words is no window. Rows are judged each by its own text, repeated ones
and those with one doc_id or none too; texts of any length are read whole. Empty tables give empty results or no hits. Other
columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH = 10
#: Windows of the benchmark whose hashes may be broadcast (some 100 bytes each in the hash table); more are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Documents with hits whose keys (16 bytes each) may be broadcast.
BROADCAST_KEYS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _hash(w: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(w, at + k) for k in range(width)])


def _window_at(w: Column, width: int):
    return lambda _, i: F.struct(_hash(w, i, width).alias("h"), i.alias("at"), F.lit(width).alias("width"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """A row for each distinct window: number, h (its hash), width and gram (its words); and number and item of each item that has it."""
    base = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    wide = F.least(F.size("w"), F.lit(width))
    starts = base.select("item", "w", wide.alias("width"), F.explode(F.sequence(F.lit(0), F.size("w") - wide)).alias("at"))
    grams = stored(starts.select("item", "width", F.slice("w", F.col("at") + 1, F.col("width")).alias("gram")).distinct(), "grams")
    g = F.col("gram")
    h = F.lit(None).cast("long")
    for k in range(1, width + 1):
        h = F.when(F.col("width") == k, _hash(g, F.lit(0), k)).otherwise(h)
    windows = stored(grams.select("width", "gram").distinct().select(F.monotonically_increasing_id().alias("number"), h.alias("h"), "width", "gram"), "windows")
    return windows, stored(grams.join(windows, ["width", "gram"]).select("number", "item"), "members")


def _keyed(docs: DataFrame) -> list[Column]:
    """What tells a row's text from others: its doc_id and a hash of the text."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash")]


def hits(docs: DataFrame, windows: DataFrame, width: int = WIDTH, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """__id, __text_hash, at (0-based word), width and number of each occurrence of a window, verified on the words.

    Hashes of windows are streamed from the scan of docs into a hash join with those of the benchmark's, which are broadcast if they are
    `limit` at most, else joined by a shuffle. Only the documents that hit are read again: what tells them apart is broadcast if they are
    `BROADCAST_KEYS` at most, so that no other text is shuffled, and the words of their hits are joined with those of the windows.
    """
    size, lengths = windows.agg(F.count(F.lit(1)), F.collect_set("width")).first()
    key = ["__id", "__text_hash"]
    base = docs.select(*_keyed(docs), normal_words(F.col("text")).alias("w"))
    w = F.col("w")
    parts = []
    for k in sorted(lengths) or [width]:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
        parts.append(F.transform(starts, _window_at(w, k)))
    hashes = windows.select("h", "width").distinct()
    spread = base.select(*key, F.inline(F.concat(*parts)))
    maybe = stored(spread.join(F.broadcast(hashes) if size <= limit else hashes, ["h", "width"]), "maybe")
    each = maybe.groupBy(*key).agg(F.collect_set(F.struct("h", "at", "width")).alias("__maybe")).withColumnsRenamed({c: f"{c}2" for c in key})
    alike = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__text_hash") == F.col("__text_hash2"))
    ids = stored(maybe.select(*[F.col(c).alias(f"{c}2") for c in key]).distinct(), "ids")
    texts = docs.select(*_keyed(docs), "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, alike, "left_semi")
    own = texts.dropDuplicates(key).select(*key, normal_words(F.col("text")).alias("w")).join(each, alike)
    gram = lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), x["width"].alias("width"), F.slice("w", x["at"] + 1, x["width"]).alias("gram"))
    told = own.select(*key, F.explode(F.transform("__maybe", gram)).alias("x"))
    return told.select(*key, "x.*").join(windows, ["h", "width", "gram"]).select(*key, "at", "width", "number")


def _spots(hit: Column) -> Column:
    """Places of words inside occurrences, each once."""
    return F.array_distinct(F.flatten(F.transform(hit, lambda x: F.sequence(x["at"], x["at"] + x["width"] - 1))))


def found(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Of each text with hits: __id, __text_hash, spots (0-based places of words inside occurrences) and set_id; and the items (ids as
    strings, sorted) of each set_id, which is a set of windows."""
    windows, members = benchmark_windows(benchmark, width)
    per = hits(docs, windows, width, limit).groupBy("__id", "__text_hash").agg(F.collect_set(F.struct("at", "width")).alias("h"), F.array_sort(F.collect_set("number")).alias("numbers"))
    own = stored(per.select("__id", "__text_hash", _spots(F.col("h")).alias("spots"), F.sha2(F.array_join("numbers", ","), 256).alias("set_id"), "numbers"), "hits")
    sets = own.select("set_id", "numbers").dropDuplicates(["set_id"]).select("set_id", F.explode("numbers").alias("number"))
    items = sets.join(members, "number").select("set_id", "item").distinct().groupBy("set_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return own.drop("numbers"), stored(items, "items")


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences), n_items, items_sha256 (of the ids of items, sorted as strings, comma-joined), set_id
    (null without a hit; `found` has the items of each) and contaminated."""
    own, items = found(docs, benchmark, width, limit)
    about = items.select("set_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    told = own.select(F.col("__id").alias("__id2"), F.col("__text_hash").alias("__text_hash2"), F.size("spots").cast("long").alias("n_hit"), "set_id").join(about, "set_id")
    base = docs.select("doc_id", *_keyed(docs), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    both = base.join(told, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__text_hash") == F.col("__text_hash2")), "left")
    n = F.coalesce("n_hit", F.lit(0))
    return both.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), "set_id", (n > 0).alias("contaminated"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("__row"), *_keyed(docs))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    windows, _ = benchmark_windows(benchmark, width)
    bad = stored(hits(docs, windows, width).select(F.col("__id").alias("__id2"), F.col("__text_hash").alias("__text_hash2")).distinct(), "bad")
    alike = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__text_hash") == F.col("__text_hash2"))
    return _rows(docs).join(bad, alike, "left_anti").select("__row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, in each text of which the words inside occurrences are cut out with what stands between them.

    Other characters of the text stay as they are; a text without a hit is unchanged.
    """
    own = found(docs, benchmark, width)[0].withColumnsRenamed({"__id": "__id2", "__text_hash": "__text_hash2"})
    both = _rows(docs).join(own, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__text_hash") == F.col("__text_hash2")), "left")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F\x41-\x5A]|[\x41-\x5A]"
    body = F.col("__row.text")
    parts = both.select("__row", F.col("spots").alias("__spots"), F.split(body, f"(?:{word})++", -1).alias("__gaps"), F.regexp_extract_all(body, F.lit(f"((?:{word})++)"), 1).alias("__raw"))
    hit = lambda i: F.array_contains("__spots", i)
    pieces = F.transform("__gaps", lambda gap, i: F.concat(F.when(hit(i) & hit(i - 1), "").otherwise(gap), F.when(hit(i), "").otherwise(F.coalesce(F.get("__raw", i), F.lit("")))))
    text = F.when(F.col("__spots").isNull(), F.col("__row.text")).otherwise(F.array_join(pieces, ""))
    return parts.select(F.col("__row").withField("text", text).alias("__row")).select("__row.*")
