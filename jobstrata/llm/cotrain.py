"""Quality by co-training: a classifier of the text and one of the page's record (language, source, stated length) teach each other over rounds.

The views share no input: the first reads the text alone, the second never does.

Both are fitted on labelled rows. In each round either view scores unlabelled documents, and those of which it is most sure, of
both classes, join the other view's rows with the label it gave them. At the end each view is calibrated on labelled rows that it
was not fitted on (a logistic curve over its score), and a document's score is the mean of the two calibrated log-odds, a view
that says nothing about it counting less.

Only labelled rows are sampled (`EACH` at most of either label); all rows outside the sample count as unlabelled, whatever the table of
labels says of them. In each round all unlabelled rows are scored on the executors from
features written once, and every one of which a view is surer than `SURE` teaches the other: the driver adds the gradients of its
labelled rows and the sums of those of all rows that were given labels, `STEPS` times a round. The given labels of a class weigh
half of what its labelled rows do, however many they are. Scoring covers every row. Null and empty texts have no words: the
metadata alone decide; a null in the record is a value like another, a null length says nothing. Very long texts take linear time and one
of them is held at a time. Ties: a row of which both views are sure and say different things teaches nobody; score >= KEEP keeps.
Without labels of both kinds, or with an empty table of labels, every score is 0.5; no documents give no rows. Null ids are scored and never learnt from. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .learn import Adam, fold, sample, sigmoid

EACH, ROUNDS, STEPS, SURE, BUCKETS = 2_000, 3, 4, 0.9, 1 << 14
KEEP = 0.5
_SHAPE = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES, _LAYOUT, _LENGTHS, _TAGS = 5, 7, 48, 1024


class _Buckets(dict):
    """word -> bucket of its hash, for the words met last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return value


def content(text: str | None, known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text's words and of what they look like: repeats, marks at their ends and case."""
    words = _SHAPE.findall(text or "")
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    number, often = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, n), return_counts=True)
    share = np.sqrt(often / n)
    repeat = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    marks = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" for w in words) / n
    shape = np.array([repeat, marks, len(number) / n, sum(map(str.isupper, words)) / n, min(1.0, n / 50)])
    return np.append(number, BUCKETS + np.arange(_SHAPES)), np.append(share, shape)


def metadata(page: int | str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of what a page's record says: the length it states, its language, its source, and both of these.

    page: the stated length. Of a table whose records state none the page itself, of which only the layout is read, no words.
    """
    spots, values = [0], [1.0]
    if isinstance(page, str):
        n, lines = len(page), page.count("\n") + 1
        spots += range(1, 1 + _LAYOUT)
        values += [np.log1p(n) / 12, np.log1p(lines) / 8, np.log1p(n / lines) / 10, page.count("  ") / (n + 1), sum(map(page.count, "#*$%&|<>")) * 10 / (n + 1), page.count("!") * 10 / (n + 1), float(n < 300)]
    elif page is not None:
        spots.append(1 + _LAYOUT + min(_LENGTHS - 1, int(2 * np.log2(max(0, page) + 1))))
        values.append(1.0)
    own = [1 + _LAYOUT + _LENGTHS + zlib.crc32(k.encode("utf-8", "surrogatepass")) % _TAGS for k in (f"both:{lang}:{source}", f"lang:{lang}", f"source:{source}")]
    return np.array([*spots, *own], np.int64), np.array([*values, 1.0, 1.0, 1.0])


@dataclass
class View:
    """A logistic classifier and its calibration: log-odds = slope * score + shift."""

    theta: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.theta[row[0]] @ row[1] + self.theta[-1])

    def odds(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return float(np.clip(self.slope * self.raw(row) + self.shift, -20, 20)) if len(row[0]) else 0.0


def _fit(rows: list, y: np.ndarray, w: np.ndarray, size: int, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> View:
    flat, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    theta, w = np.zeros(size + 1), w / w.sum()
    adam = Adam(size + 1, rate)
    for _ in range(steps):
        g = w * (sigmoid(np.bincount(owner, theta[flat] * value, len(rows)) + theta[-1]) - y)
        grad = np.append(np.bincount(flat, g[owner] * value, size), g.sum())
        grad[:-1] += decay * theta[:-1]
        adam.step(theta, grad)
    return View(theta)


def _calibrated(view: View, rows: list, y: np.ndarray, w: np.ndarray) -> View:
    x = np.array([view.raw(r) for r in rows])
    a, b, w = np.array([1.0, 0.0]), Adam(2, 0.05), w / w.sum()
    for _ in range(300):
        g = w * (sigmoid(a[0] * x + a[1]) - y)
        b.step(a, np.array([g @ x + 1e-3 * (a[0] - 1), g.sum()]))
    return View(view.theta, max(0.0, float(a[0])), float(a[1]))


@dataclass
class Model:
    views: tuple[View, View] | None
    history: list[dict]

    def score(self, rows: tuple) -> tuple[float, float, float]:
        """The combined probability, and that of either view."""
        if self.views is None:
            return 0.5, 0.5, 0.5
        own = [v.odds(r) for v, r in zip(self.views, rows, strict=True)]
        used = [x for x, r in zip(own, rows, strict=True) if len(r[0])]
        return tuple(float(sigmoid(np.float64(z))) for z in (sum(used) / len(used), *own))


@dataclass
class Rows:
    """Sparse rows of a view: the places and values of all, and which row each belongs to."""

    flat: np.ndarray
    value: np.ndarray
    owner: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: list) -> Rows:
        flat, value = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0, kind) for k, kind in ((0, np.int64), (1, float)))
        return cls(flat, value, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), len(rows))

    def raw(self, theta: np.ndarray) -> np.ndarray:
        """The score of each row; zero of one without features, as it says nothing."""
        known = np.bincount(self.owner, minlength=self.n) > 0
        return np.where(known, np.bincount(self.owner, theta[self.flat] * self.value, self.n) + theta[-1], 0.0)

    def gradient(self, theta: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        g = w * (sigmoid(self.raw(theta)) - y)
        return np.append(np.bincount(self.flat, g[self.owner] * self.value, len(theta) - 1), g.sum())


SIZES = (BUCKETS + _SHAPES, 1 + _LAYOUT + _LENGTHS + _TAGS)
_FEATURES = "doc_id long, p0 binary, v0 binary, p1 binary, v1 binary"


_INPUTS = ("text", "page", "lang", "source")


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id and what the views read: page is the stated length, or the text of a table without one, for its layout."""
    page = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.col("text")
    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", page.alias("page"))


def _unpacked(places: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(values, "<f4").astype(float)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of both views of each row, as bytes of 16-bit places and 32-bit values."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), [[], [], [], []]
                for t, *record in zip(*(batch[c].to_pylist() for c in _INPUTS), strict=True):
                    for k, (place, value) in enumerate((content(t, known), metadata(*record))):
                        out[2 * k].append(place.astype("<u2").tobytes())
                        out[2 * k + 1].append(value.astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, pa.binary()) for c in out]], ["doc_id", "p0", "v0", "p1", "v1"])

    return _inputs(docs).mapInArrow(features, _FEATURES)


def taught(free: DataFrame, given: list[np.ndarray], now: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of free, for either view and label: gradients at `now` and how many rows; the last count is of disputed rows.

    A row's label for a view is the one that the other view of `given` is sure of, unless the views are sure of different ones.
    """
    sizes = [n + 1 for n in SIZES]

    def label(raw: np.ndarray) -> np.ndarray:
        p = sigmoid(raw)
        return np.where(p > SURE, 1, np.where(p < 1 - SURE, 0, -1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grads, counts = [[np.zeros(n), np.zeros(n)] for n in sizes], np.zeros(5)
        for batch in batches:
            rows = []
            for k in (0, 1):
                places, values = (batch[f"{c}{k}"].to_pylist() for c in "pv")
                lengths = [len(x) // 2 for x in places]
                rows.append(Rows(np.frombuffer(b"".join(places), "<u2").astype(np.int64), np.frombuffer(b"".join(values), "<f4").astype(float), np.repeat(np.arange(len(lengths)), lengths), len(lengths)))
            said = [label(r.raw(theta)) for r, theta in zip(rows, given, strict=True)]
            disputed = (said[0] >= 0) & (said[1] >= 0) & (said[0] != said[1])
            counts[4] += disputed.sum()
            for k in (0, 1):
                known = np.bincount(rows[k].owner, minlength=rows[k].n) > 0
                for y in (0, 1):
                    taken = (said[1 - k] == y) & ~disputed & known
                    counts[2 * k + y] += taken.sum()
                    grads[k][y] += rows[k].gradient(now[k], np.full(rows[k].n, float(y)), taken.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([*grads[0], *grads[1], counts]).tobytes()], pa.binary())], ["s"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * sum(sizes) + 5)
        for batch in batches:
            for x in batch["s"].to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = free.mapInArrow(sums, "s binary").withColumn("part", F.spark_partition_id())
    whole = parts.repartition(4, "part").sortWithinPartitions("part").select("s").mapInArrow(added, "s binary").withColumn("part", F.spark_partition_id())
    total = np.zeros(2 * sum(sizes) + 5)
    for r in sorted(whole.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(r["s"])
    return total[:-5], total[-5:]


def fit(labelled: list[tuple], free: DataFrame | None, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    """labelled: (features of the text, features of the record, label, weight); free: features of unlabelled rows. Every fifth labelled row is
    kept for calibration."""
    if len({r[2] for r in labelled}) < 2 or len(labelled) < 20:
        return Model(None, [])
    rows = [r[:2] for r in labelled]
    y, w = np.array([r[2] for r in labelled], float), np.array([r[3] for r in labelled], float)
    aside = np.arange(len(rows)) % 5 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(rows), bool)
    use = np.flatnonzero(~aside)
    own = [Rows.of([rows[i][v] for i in use]) for v in (0, 1)]
    ya, wa = y[use], w[use] / w[use].sum()
    thetas = [_fit([rows[i][v] for i in use], ya, wa, SIZES[v]).theta for v in (0, 1)]
    cuts = np.cumsum([SIZES[0] + 1, SIZES[0] + 1, SIZES[1] + 1])
    history = []
    for k in range(rounds if free is not None else 0):
        given, counts = [t.copy() for t in thetas], np.zeros(5)
        adams = [Adam(n + 1, 0.05) for n in SIZES]
        for _ in range(steps):
            total, counts = taught(free, given, thetas)
            if not counts[:4].any():
                break
            parts = np.split(total, cuts)
            for v in (0, 1):
                grad = own[v].gradient(thetas[v], ya, wa)
                for c in (0, 1):
                    grad += parts[2 * v + c] * (wa[ya == c].sum() / 2 / max(1.0, counts[2 * v + c]))
                grad[:-1] += 1e-4 * thetas[v][:-1]
                adams[v].step(thetas[v], grad)
        history.append({"round": k + 1, "to_text": int(counts[0] + counts[1]), "to_metadata": int(counts[2] + counts[3]), "disputed": int(counts[4])})
        if not counts[:4].any():
            break
    held = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    final = []
    for v in (0, 1):
        kept = [i for i in held if len(rows[i][v][0])]
        final.append(_calibrated(View(thetas[v]), [rows[i][v] for i in kept], y[kept], w[kept]))
    return Model((final[0], final[1]), history)


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH, pool: int | None = None) -> Model:
    """A model of a bounded sample of labelled docs and of all unlabelled ones; labels of fold 0 are never used.

    With a pool, only so many unlabelled documents are used, chosen by the hash of their ids.
    """
    chosen = sample(labels.select("doc_id", "quality"), "quality", each)
    own = docs.select("doc_id", "text", "lang", "source", *(["n_chars"] if "n_chars" in docs.columns else []))
    # features are made on the executors: at most 6 bytes for each different word of a text come to the driver, 100 kB a row
    picked = featured(own.join(F.broadcast(chosen), "doc_id")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "p0", "v0", "p1")
    rows = [(_unpacked(r["p0"], r["v0"]), _unpacked(r["p1"], r["v1"]), r["y"], r["weight"]) for r in picked.collect()]
    if len({r[2] for r in rows}) < 2:
        return Model(None, [])
    # rows are unlabelled if they aren't in the sample, whose bound lets it be broadcast: texts stay where they are
    free = own.where(F.col("doc_id").isNotNull()).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    if pool is not None:
        free = free.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool)
    return fit(rows, stored(featured(free), "features"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (1: good), text_score, metadata_score and kept (score >= KEEP) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = [model.score((content(t, known), metadata(*record))) for t, *record in zip(*(batch[c].to_pylist() for c in _INPUTS), strict=True)]
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, pa.float64()) for c in columns]], ["doc_id", "score", "text_score", "metadata_score"])

    found = _inputs(docs).mapInArrow(score, "doc_id long, score double, text_score double, metadata_score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "text_score", "metadata_score", (F.col("score") >= KEEP).alias("kept"))
