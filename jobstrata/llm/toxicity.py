"""Toxicity by multiple-instance learning: a document's score is the noisy-or of its sentences' scores, learnt from document labels.

The score of a sentence is a logistic function of the words in it; a document is toxic if at least one sentence is, so
P(document) = 1 - prod(1 - P(sentence)). Only documents are labelled; the sentences' scores, which tell the offending ones, are learnt with
them. The model is fitted on a bounded sample of labelled rows (`each` of either label); scoring covers every whole text.

Null and empty texts, and texts without letters, have no sentence with a word and score 0. Repeated rows give repeated rows. Without
labels of both kinds, or with an empty table, the model is blank and every score is 0. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import Adam, fold, sample, sigmoid, texts

#: Labelled rows of either label that the model is fitted on at most, and features it can know.
EACH, VOCABULARY = 4_000, 60_000
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """start, end and lower-cased words of each sentence with a word."""
    found = ((m.start(), m.end(), _WORD.findall(m[0].lower())) for m in _SENTENCE.finditer(text))
    return [x for x in found if x[2]]


def features(word: str) -> list[str]:
    """A word, and its beginnings of five to seven letters, so that inflected and compound words share weights."""
    return [word, *(word[:k] + "*" for k in (5, 6, 7) if len(word) >= k)]


class Words(dict):
    """word -> sum of its features' weights, for the words met last."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value


class Model:
    """weights: feature -> weight; bias: of a sentence without any known feature."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, Words(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def scores(self, text: str | None) -> np.ndarray:
        get = self.words.__getitem__
        z = [sum(map(get, set(words))) for _, _, words in sentences(text or "")]
        return sigmoid(np.array(z) + self.bias) if z else np.empty(0)

    def score(self, text: str | None) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(self.scores(text), 1 - 1e-12)).sum())) if text else 0.0


def fit(rows: list[tuple[str | None, int, float]], rounds: int = 250, rate: float = 0.1, decay: float = 1.5e-4) -> Model:
    """The model of (text, label, weight) rows, by gradient descent on the likelihood of the document labels.

    Words are numbered as they come; a word's weight is the sum of its features' weights.
    """
    number: dict[str, int] = {}
    spots, sizes, docs, y, w = array("i"), array("i"), array("i"), [], []
    for text, label, weight in rows:
        bag = sentences(text or "")
        if bag:
            for _, _, words in bag:
                own = [number.setdefault(x, len(number)) for x in dict.fromkeys(words)]
                spots.extend(own), sizes.append(len(own)), docs.append(len(y))
            y.append(label), w.append(weight)
    if len(set(y)) < 2:
        return Model({}, -40.0)
    spots, sizes, docs, y, w = (np.array(x) for x in (spots, sizes, docs, y, w))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.unique(docs[owner].astype(np.int64) * len(number) + spots) % len(number)
    often = np.bincount(pairs, minlength=len(number))
    total: Counter = Counter()
    for word, n in zip(number, often.tolist(), strict=True):
        for f in features(word):
            total[f] += n
    known = {f: i for i, (f, n) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n >= 4}
    each = [[known[f] for f in features(word) if f in known] for word in number]
    flat, of = np.fromiter(chain.from_iterable(each), np.int64), np.repeat(np.arange(len(each)), [len(x) for x in each])
    w = w / w.sum()
    theta = np.zeros(len(known) + 1)
    theta[-1] = -5.0
    adam = Adam(len(theta), rate)
    for _ in range(rounds):
        value = np.bincount(of, theta[flat], len(number))
        p = sigmoid(np.bincount(owner, value[spots], len(sizes)) + theta[-1])
        q = np.exp(np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        g = ((w * (1 - y))[docs] - (w * y * q / np.maximum(1 - q, 1e-9))[docs]) * p
        grad = np.append(np.bincount(flat, np.bincount(spots, g[owner], len(number))[of], len(known)), g.sum())
        grad[:-1] += decay * np.sign(theta[:-1]) + decay * theta[:-1]
        adam.step(theta, grad)
    return Model({k: float(theta[i]) for k, i in known.items() if abs(theta[i]) > 0.02}, float(theta[-1]))


def trained(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model:
    """A model of `each` labelled documents at most of either label; rows of fold 0 are never used."""
    chosen = sample(labels.select("doc_id", "toxic"), "toxic", each)
    return fit([(r["text"], r["y"], r["weight"]) for r in texts(docs.select("doc_id", "text"), chosen)])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, with the place of the worst sentence (start, end; null if none)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                p = model.scores(text)
                if not len(p):
                    out.append((0.0, None, None, None))
                    continue
                start, end, _ = sentences(text)[k := int(p.argmax())]
                out.append((float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), start, end, float(p[k])))
            s, a, b, w = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, worst_start long, worst_end long, worst_score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def located(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (0-based, of those with a word), start, end (code points) and score of each sentence at `least` or above."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, a, b, float(p)) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if t for k, ((a, b, _), p) in enumerate(zip(sentences(t), model.scores(t), strict=True)) if p >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "sentence", "start", "end", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(locate, "doc_id long, sentence long, start long, end long, score double")
