"""Hooks for models, with deterministic stand-ins that need no network."""

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIMENSIONS = 64


#: Characters that the model which this stands for reads, and odd numbers that hash a trigram's code points.
READ, ODD = 8_000, np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


#: Characters of texts that are embedded at once.
EMBEDDED = 500_000


def _embed_all(text: pd.Series) -> pd.Series:
    """Vectors of a batch of texts, EMBEDDED characters or one text at a time, as a character takes some hundred bytes."""
    out, texts, size = [], [], 0
    for x in text:
        t = (x or "").strip().lower()[:READ]
        if texts and size + len(t) > EMBEDDED:
            out += _embed_some(texts)
            texts, size = [], 0
        texts.append(f" {t} " if t else "")
        size += len(t)
    return pd.Series(out + _embed_some(texts), dtype=object)


def _embed_some(texts: list[str]) -> list:
    """Vectors of some texts: all code points in one array, a trigram for each place, sums by text and bucket."""
    size = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    if len(codes) < 3:
        return [None] * len(texts)
    h = codes[:-2] * ODD[0] + codes[1:-1] * ODD[1] + codes[2:] * ODD[2]
    h ^= h >> np.uint64(31)
    h *= ODD[0]
    h ^= h >> np.uint64(29)
    own = row[:-2] == row[2:]
    place = row[:-2][own] * DIMENSIONS + (h[own] % np.uint64(DIMENSIONS)).astype(np.int64)
    sums = np.bincount(place, np.where(h[own] >> np.uint64(63), 1.0, -1.0), len(texts) * DIMENSIONS).reshape(-1, DIMENSIONS)
    length = np.sqrt((sums * sums).sum(axis=1))
    unit = np.divide(sums, length[:, None], out=np.zeros_like(sums), where=length[:, None] > 0).astype(np.float32)
    return [u if n else None for u, n in zip(unit, length)]


def embed_text(text: str | Column) -> Column:
    """A text's vector: hashed character trigrams; none for an empty text."""
    return F.pandas_udf(_embed_all, "array<float>")(text)


def overlap_score(query: Column, text: Column) -> Column:
    """A relevance score: the share of the query's distinct words that the first 8,000 characters of the text hold.

    The limit is that of the scoring model which this stands for.
    """
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(F.left(text, F.lit(8_000))))) / F.size(q)).otherwise(F.lit(0.0))


#: What a failing model, its client or a task that ran it raises; an error in the plan's own code isn't among these.
FAILURES = (RuntimeError, ConnectionError, TimeoutError, PythonException, Py4JJavaError)


def with_fallback(plan, otherwise, failures: tuple[type[Exception], ...] = FAILURES) -> DataFrame:
    """The first plan's rows, or the other plan where building or running it fails by one of `failures`: it is run and written, so that nothing fails later."""
    from ..sources.shared import materialised

    try:
        return materialised(plan(), "first-choice")
    except failures:
        return otherwise()


def replied(rows: DataFrame, key: str, template: str, model) -> DataFrame:
    """(key, reply): `model(key, template's text)`, or that text where the model raises or says nothing."""

    def run(keys: pd.Series, texts: pd.Series) -> pd.Series:
        def one(k, text):
            try:
                return (model(k, text) or "").strip() or text
            except Exception:  # whatever a model's client raises
                return text

        return pd.Series([one(k, t) for k, t in zip(keys, texts)], dtype=object)

    return rows.select(key, F.pandas_udf(run, "string")(F.col(key), F.col(template)).alias("reply"))


def caption(batches):
    """mapInPandas: an image's caption as JSON from its name; a failure gives a marker."""
    for b in batches:
        b["caption"] = ['{"image_name": "%s"}' % n.replace('"', "'") if isinstance(n, str) and n else "[caption failed]" for n in b["name"]]
        yield b
