"""Quality classifier: attention-based multiple-instance learning with gated attention.

A document is a bag of passages of about `PASSAGE` code points that cover its whole text. Each passage is encoded as
hashed character trigrams and shares of character classes, and a learned layer makes that h = tanh(W e + b). The gate

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )

weighs the passages; the document's score is sigmoid(c . sum_k a_k h_k + d). Only document labels are learnt from; all
weights are trained together, by Adam on batches of documents, from a bounded sample: at most `SAMPLE` of each label. The
model is a few matrices of fixed size.

Cases: null or empty texts are one passage without characters; equal texts get equal scores; with no labelled rows, or
one label only, every score is the share of label 1 (0 without any); an empty table gives an empty result; columns
beyond `doc_id` and `text` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, runs, texts, tidy

SAMPLE = 3000
PASSAGE = 500
HASHED = 128
WIDTH = HASHED + 11
HIDDEN = 32
GATE = 16
THRESHOLD = 0.7

#: Classes of characters: 0 lower-case a-z, 1 upper-case A-Z, 2 digit, 3 blank, 4 line end, 5 other ASCII, 6 Latin-1 letters, 7 the rest.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
for _range, _kind in (((97, 123), 0), ((65, 91), 1), ((48, 58), 2), ((32, 33), 3), ((9, 10), 3), ((10, 11), 4), ((128, 192), 7)):
    _CLASS[slice(*_range)] = _kind


def encode(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The passages of all texts, encoded, and the number of passages of each text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in batch]
    size = np.array([len(p) for p in points], np.int64)
    many = np.maximum(1, -(-size // PASSAGE))
    owner = [np.arange(n) * k // max(1, n) for n, k in zip(size.tolist(), many.tolist())]
    first = np.r_[0, np.cumsum(many)]
    passages = int(first[-1])
    c = np.concatenate(points).astype(np.uint32)
    at = np.concatenate(owner) + np.repeat(first[:-1], size)
    kind = np.where(c < 256, _CLASS[np.minimum(c, 255)], 7)
    classes = np.bincount(at * 8 + kind, minlength=passages * 8).reshape(-1, 8).astype(np.float32)
    total = np.maximum(classes.sum(axis=1, keepdims=True), 1)
    if len(c) > 2:
        h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(25)
        inside = at[:-2] == at[2:]
        grams = np.bincount((at[:-2] * HASHED + h)[inside], minlength=passages * HASHED).reshape(-1, HASHED).astype(np.float32)
    else:
        grams = np.zeros((passages, HASHED), np.float32)
    seen = grams.sum(axis=1, keepdims=True)
    share = grams / np.maximum(seen, 1)
    same = (grams * (grams - 1)).sum(axis=1, keepdims=True) / np.maximum(seen * (seen - 1), 1)
    # the last three: how often two trigrams of the passage are the same, how often a word repeats the one before, and the size
    extra = np.concatenate([5 * classes / total, 20 * same, 5 * _echoes(c, kind, at, passages)[:, None], np.log1p(total) / 6], axis=1)
    return np.concatenate([np.sqrt(share) * 3, extra], axis=1).astype(np.float32), many


def portions(batch: list[str], size: int = 500_000) -> list[list[str]]:
    """The texts in order, in lists of about `size` characters, so that encoding needs memory for one of them at a time."""
    at = np.cumsum([len(t) for t in batch]) // size
    return [batch[s:e] for s, e in zip(*runs(at))] if batch else []


def _echoes(c: np.ndarray, kind: np.ndarray, at: np.ndarray, passages: int) -> np.ndarray:
    """For each passage, the share of its words that equal the word before."""
    blank = (kind == 3) | (kind == 4)
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if len(start) < 2:
        return np.zeros(passages, np.float32)
    place = np.arange(len(c))
    begun = np.zeros(len(c), np.int64)
    begun[start] = start
    place -= np.maximum.accumulate(begun)
    word = np.add.reduceat(np.where(blank, 0, (c * np.uint32(0x9E3779B1) >> np.uint32(3)).astype(np.int64) * (1 + place)), start)
    again = np.r_[False, (word[1:] == word[:-1]) & (at[start[1:]] == at[start[:-1]])]
    return (np.bincount(at[start], again, passages) / np.maximum(np.bincount(at[start], minlength=passages), 1)).astype(np.float32)


@dataclass
class Model:
    w: dict[str, np.ndarray]
    share: float | None = None

    def score(self, batch: list[str]) -> np.ndarray:
        if not batch:
            return np.empty(0)
        if self.share is not None:
            return np.full(len(batch), self.share)
        x, many = encode(batch)
        return forward(self.w, x, many)["p"].astype(np.float64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w, x, many) -> dict:
    start = np.r_[0, np.cumsum(many)[:-1]]
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), many))
    a = e / np.repeat(np.add.reduceat(e, start), many)
    z = np.add.reduceat(a[:, None] * h, start)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "start": start, "p": _sigmoid(z @ w["c"] + w["d"][0])}


def gradients(w, x, many, y, weight) -> dict:
    f = forward(w, x, many)
    h, t, g, a, z, start = (f[k] for k in ("h", "t", "g", "a", "z", "start"))
    dp = (f["p"] - y) * weight / len(y)
    out = {"c": z.T @ dp, "d": np.array([dp.sum()])}
    dz = np.repeat(dp[:, None] * w["c"], many, axis=0)
    dh = a[:, None] * dz
    da = (h * dz).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, start), many))
    out["w"] = (t * g).T @ de
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    out["V"], out["U"] = h.T @ dt, h.T @ dg
    dh = (dh + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    out["W"], out["b"] = x.T @ dh, dh.sum(axis=0)
    return out


def fit(rows: list[tuple[str, int]], share: float, epochs: int = 15, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """`share`: of label 1 in the whole labelled table; the sample's labels are weighted to it."""
    y = np.array([label for _, label in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return Model({}, share)
    rng = np.random.default_rng(0)
    size = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in size.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    parts = [encode(part) for part in portions([t for t, _ in rows])]
    x, many = (np.concatenate(z) for z in zip(*parts))
    start = np.r_[0, np.cumsum(many)]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    n = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            docs = order[i : i + batch]
            lines = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            n += 1
            for k, g in gradients(w, x[lines], many[docs], y[docs], weight[docs]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**n) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8) + decay * w[k])).astype(np.float32)
    return Model(w)


def train(docs: DataFrame, labels: DataFrame, learn: str = "true", sample: int = SAMPLE) -> Model:
    """`labels`: (doc_id, label 0/1); `learn`: the condition on doc_id of the rows that may be learnt from."""
    return fit(*labelled(docs, labels, learn, sample))


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches):
        for b in batches:
            out = [model.score(part) for part in portions(list(texts(b.column(1))))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], schema=SCORES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
