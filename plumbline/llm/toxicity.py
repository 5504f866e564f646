"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences.  A sentence's score is logistic in the features of its
words, 0 if below ``FLOOR``, and the document's is the noisy-or of its sentences: the chance that at least one
is toxic.  Training needs labels of documents only; afterwards the sentence scores say
where the offence is.

A word's features are the word itself and its first four and five letters, lower-cased;
text between ``. ! ?`` and line ends is a sentence, cut after ``SENTENCE_WORDS`` words.
The model is fitted in the driver on a bounded sample of labelled rows (``max_docs`` of
each label, in the order of a seeded hash); their texts are taken apart on the executors
as wholes.  Features seen in fewer than ``min_docs`` sampled rows, or about as often with
either label, have no weight, so the model is small.  Scoring runs over whole texts.

Nulls: a null or empty text has no sentence and the score 0.  Rows without a label, or
without an id, teach nothing.  Repeated rows are scored each.  Without any toxic
(or any clean) labelled row every score is 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, hidden

#: Rows of each label that the model is fitted on, at most.
MAX_DOCS = 1500
SENTENCE_WORDS = 48
PREFIXES = (4, 5)
THRESHOLD = 0.7
#: A sentence less likely than this counts as 0: else length alone would accuse a long text.
FLOOR = 0.05
_LEAST = float(np.log(FLOOR / (1 - FLOOR)))
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its longer prefixes, below 2^31."""
    names = [word] + [word[:k] + "*" for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh32_intdigest(x, 7) >> 1 for x in names]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence that has words, in code points."""
    for m in _SENTENCE.finditer(text):
        spans = [(w.start(), w.end(), w.group().lower()) for w in _WORD.finditer(text, m.start(), m.end())]
        for i in range(0, len(spans), SENTENCE_WORDS):
            part = spans[i : i + SENTENCE_WORDS]
            yield part[0][0], part[-1][1], [w for _, _, w in part]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def scorer(self):
        """A function from texts to (document score, [(start, end, sentence score) of sentences above one half])."""
        cache: dict[str, float] = {}

        def weight(word: str) -> float:
            if len(cache) > 500_000:
                cache.clear()
            cache[word] = out = self.word_weight(word.lower())
            return out

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            if not text or not self.weights:
                return 0.0, []
            total, places, get = 0.0, [], cache.get
            for m in _SENTENCE.finditer(text):
                words = _WORD.findall(m.group())
                for i in range(0, len(words), SENTENCE_WORDS):
                    z, heavy = 0.0, False
                    for w in set(words[i : i + SENTENCE_WORDS]):
                        v = get(w)
                        if v is None:
                            v = weight(w)
                        if v:
                            z, heavy = z + v, True
                    z += self.bias
                    if not heavy or z < _LEAST:
                        continue
                    total += float(np.logaddexp(0.0, z))
                    if z > 0:
                        places.append((m.start(), i))
            if not places:
                return -float(np.expm1(-total)), []
            located = []
            wanted = {s for s, _ in places}
            for m in _SENTENCE.finditer(text):
                if m.start() in wanted:
                    for start, end, words in sentences(m.group()):
                        p = 1 / (1 + np.exp(-min(50.0, self.bias + sum(self.word_weight(w) for w in set(words)))))
                        if p > 0.5:
                            located.append((m.start() + start, m.start() + end, float(p)))
            return -float(np.expm1(-total)), located

        return score


def fit(ids: np.ndarray, sentence_at: np.ndarray, bag_at: np.ndarray, labels: np.ndarray, min_docs: int = 4, steps: int = 400, rate: float = 0.1, l1: float = 0.05) -> Model:
    """The model of bags: feature ids, where each sentence starts in them, and where each bag starts in the sentences."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, 0.0)
    bag_of_sentence = np.repeat(np.arange(len(labels)), np.diff(np.append(bag_at, len(sentence_at))))
    sentence_of = np.repeat(np.arange(len(sentence_at)), np.diff(np.append(sentence_at, len(ids))))
    names, feature = np.unique(ids, return_inverse=True)
    # in how many documents of either label a feature occurs
    feature, sentence_of = feature.astype(np.int32), sentence_of.astype(np.int32)
    pairs = np.unique(feature.astype(np.int64) * len(labels) + bag_of_sentence[sentence_of])
    owner, toxic = pairs // len(labels), labels[pairs % len(labels)] > 0
    pos, neg = np.bincount(owner[toxic], minlength=len(names)), np.bincount(owner[~toxic], minlength=len(names))
    n_pos, n_neg = labels.sum(), len(labels) - labels.sum()
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    spread = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    kept = np.flatnonzero((pos + neg >= min_docs) & (np.abs(odds) > 3 * spread))
    if not len(kept):
        return Model({}, 0.0)
    place = np.full(len(names), -1)
    place[kept] = np.arange(len(kept))
    f, s = place[feature], sentence_of
    f, s = f[f >= 0], s[place[feature] >= 0]
    w, b = np.zeros(len(kept)), -3.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # either label counts alike, whatever its share of the sample
    share = np.where(labels > 0, 0.5 / n_pos, 0.5 / n_neg)
    for t in range(1, steps + 1):
        z = np.bincount(s, w[f], minlength=len(sentence_at)) + b
        keep = np.bincount(bag_of_sentence, np.logaddexp(0, z), minlength=len(labels))  # -log of (1 - document score)
        # slope of the log-loss in keep: 1 for a clean document, -q / (1 - q) for a toxic one, with q = exp(-keep)
        slope = np.where(labels > 0, -1 / np.expm1(np.clip(keep, 1e-6, 50)), 1.0) * share
        dz = slope[bag_of_sentence] / (1 + np.exp(-z))
        dw, db = np.bincount(f, dz[s], minlength=len(kept)), dz.sum()
        m, v = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw * dw
        mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
        up, upb = (1 - 0.9**t), (1 - 0.999**t)
        w -= rate * (m / up) / (np.sqrt(v / upb) + 1e-9)
        b -= rate * (mb / up) / (np.sqrt(vb / upb) + 1e-9)
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate, 0)
    # what is common in clean text does not excuse, and a weak hint does not accuse
    return Model({int(names[k]): float(x) for k, x in zip(kept, w) if x > 0.5}, float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", where: Column | None = None, max_docs: int = MAX_DOCS, seed: int = 42) -> Model:
    """A model from the documents that ``labels`` (key, label) marks 1 or 0 and for which ``where`` holds."""
    known = labels.select(col(key).alias("k"), col(label).alias("y")).where("k is not null and y in (0, 1)")
    # a document with both marks is toxic
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    if where is not None:
        known = known.withColumnRenamed("k", key).where(where).withColumnRenamed(key, "k")
    order = F.xxhash64(F.lit(seed), "k")
    picked = [known.where(F.col("y") == y).orderBy(order, "k").limit(max_docs) for y in (0, 1)]
    picked = picked[0].union(picked[1])  # at most 2 * max_docs ids
    rows = docs.select(col(key).alias("k"), col(text).alias("t")).join(F.broadcast(picked), "k").select("k", "t", "y")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"k": [], "y": [], "n": [], "ids": []}
            for k, t, y in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [sorted({f for w in set(words) for f in features(w)}) for _, _, words in sentences(t or "")]
                out["k"].append(k)
                out["y"].append(y)
                out["n"].append(np.array([len(p) for p in parts], "<i4").tobytes())
                out["ids"].append(np.array([f for p in parts for f in p], "<i4").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("k", pa.string()), ("y", pa.int32()), ("n", pa.binary()), ("ids", pa.binary())]))

    parts = rows.select(F.col("k").cast("string"), "t", F.col("y").cast("int")).mapInArrow(take_apart, "k string, y int, n binary, ids binary")
    got = parts.toArrow().sort_by([("k", "ascending"), ("n", "ascending"), ("ids", "ascending")])
    if not got.num_rows:
        return Model({}, 0.0)
    counts = [np.frombuffer(x.as_py(), "<i4") for x in got["n"]]
    ids = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in got["ids"]])
    y = got["y"].to_numpy()
    # documents without words are no bags
    full = np.array([len(x) > 0 for x in counts])
    counts, y = [x for x in counts if len(x)], y[full]
    if not counts:
        return Model({}, 0.0)
    sizes = np.concatenate(counts)
    del got, parts
    return fit(ids, np.cumsum(sizes) - sizes, np.cumsum([len(x) for x in counts]) - [len(x) for x in counts], y)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", places: str = "offending") -> DataFrame:
    """``docs`` with the score of each whole text and the spans of its offending sentences."""

    kind = "score double, places array<struct<start:int,end:int,score:double>>"
    made = hidden(docs, "_made")

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for texts in batches:
            found = [of(t) for t in texts]
            yield pd.DataFrame(
                {"score": [x for x, _ in found], "places": [[{"start": a, "end": b, "score": p} for a, b, p in y] for _, y in found]}
            )

    out = docs.withColumn(made, run(col(text).cast("string")))
    keep = [col(c) for c in docs.columns if c.lower() not in (name.lower(), places.lower())]
    return out.select(*keep, F.col(f"{made}.score").alias(name), F.col(f"{made}.places").alias(places))
