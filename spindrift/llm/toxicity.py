"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (NBSVM's features).

A text's features are the distinct n-grams of 3 to 5 code points of its lower-cased form, hashed. Each counts
r = log((p + a) / (q + a)), p and q being the shares of toxic and clean texts that hold it, and a linear model over those
scaled features is fitted by logistic regression. Ratios and weights come from a bounded sample of the labelled rows: at
most `SAMPLE` of each label, those with the smallest hash of their doc_id, however large the corpus is. The model is one
vector of `BUCKETS` numbers, so what travels to the tasks is bounded too.

Cases: null or empty texts get the model's intercept; equal texts get equal scores; with no labelled rows, or one label
only, every score is the share of toxic labels (0 without any); an empty table gives an empty result; columns beyond
`doc_id` and `text` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, mix, texts, tidy

SAMPLE = 4000
BUCKETS = 1 << 20
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
#: Ratios closer to zero than this say nothing; their n-grams are left out.
FLAT = 0.4


def features(text: str) -> np.ndarray:
    """The distinct buckets of the text's n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points = np.r_[np.uint64(32), points, np.uint64(32)]
    words = mix(points * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    out = []
    h = words
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            break
        h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[n - 1 :]
        if n in GRAMS:
            out.append(h ^ (h >> np.uint64(32)) ^ np.uint64(n * 0x9E3779B1))
    if not out:
        return np.empty(0, np.int64)
    h = np.concatenate(out) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 20)
    h = h.astype(np.int64)
    # of places with the same bucket, the last one stays: no sort is needed
    place = np.arange(len(h), dtype=np.int32)
    _last[h] = place
    return h[_last[h] == place]


#: Scratch space of one process: which place of the text at hand had a bucket last.
_last = np.zeros(BUCKETS, np.int32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[features(text)].sum(dtype=np.float64), -30, 30))))


def fit(rows: list[tuple[str, int]], share: float, epochs: int = 6, smooth: float = 1.0, rate: float = 0.05, decay: float = 1e-6) -> Model:
    """`rows`: (text, label); `share`: of toxic labels in the whole labelled table, which the sample's balance may not show."""
    y = np.array([label for _, label in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    counts = np.zeros((2, BUCKETS), np.float32)
    for text, label in rows:
        counts[int(label), features(text)] += 1
    many = np.bincount(y.astype(int), minlength=2)
    ratio = np.log((counts[1] + smooth) / (many[1] + 2 * smooth)) - np.log((counts[0] + smooth) / (many[0] + 2 * smooth))
    seen = counts.sum(axis=0)
    ratio[(seen < 3) | (np.abs(ratio) < FLAT)] = 0
    # features are made twice rather than kept: only those that tell something are held
    telling, found = ratio != 0, []
    for text, _ in rows:
        f = features(text)
        found.append(f[telling[f]].astype(np.int32))
    # logistic regression over the scaled features, each text's length taken out of its step
    weight, bias = np.zeros(BUCKETS), 0.0
    square = np.full(BUCKETS, 1e-3)
    balance = np.where(y == 1, 0.5 / many[1], 0.5 / many[0]) * len(y)
    rng = np.random.default_rng(0)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            f = found[i]
            r = ratio[f]
            margin = bias + (weight[f] * r).sum()
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            g = (p - y[i]) * balance[i]
            step = g * r + decay * weight[f]
            square[f] += step * step
            weight[f] -= rate * step / np.sqrt(square[f])
            bias -= rate * 0.1 * g
    return Model((weight * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, learn="true", sample: int = SAMPLE) -> Model:
    """`labels`: (doc_id, label 0/1); `learn`: the condition on doc_id of the rows that may be learnt from."""
    return fit(*labelled(docs, labels, learn, sample))


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in texts(b.column(1))], pa.float64())], schema=SCORES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def rejected(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more; with `keep`, the others.

    Only texts go to Python and only scores come back: a condition of the rows, which has no column of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        for c in columns:
            yield pa.array([m.score(t) for t in texts(c)], pa.float64())

    score_of = F.arrow_udf(scores, "double")
    found = score_of(F.col("text").cast("string"))
    return docs.where(found < threshold if keep else found >= threshold)
