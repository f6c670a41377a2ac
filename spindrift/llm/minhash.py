"""Document fingerprints by MinHash, and near-duplicate classes from their bands.

A text's shingles are its runs of five words (A-Z in lower case, cut at ASCII white space; fewer words: the whole
sequence; none: no shingle). `PERMUTATIONS` universal hash functions x -> a x + b (mod 2^32, a odd, so each permutes the
32-bit numbers) are applied to all shingles at once in numpy, and the least value of each is kept in 16 bits. The share
of equal values estimates the Jaccard similarity of the shingle sets.

`near_duplicates` joins bands of `ROWS` values in Spark: texts that agree in a band are candidates, and the Jaccard similarity of
their shingle sets is computed exactly. Texts of similarity s agree in some of the 21 bands with a probability of
1 - (1 - s^6)^21 (0.998 at 0.8). Equal texts are one node from the start.

`edited` pairs every document with the next one in order of doc_id without a global sort: documents are dealt to ranges
of doc_id, and the first of each range also goes to the end of the range before.

Cases: null is the empty text; texts without words are equal to each other and to nothing else; equal doc_ids are ordered
by text, null doc_ids come first; an only document is its own next; an empty table gives an empty result; columns
beyond `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, partitions, runs, texts, tidy
from .components import components

SHINGLE = 5
PERMUTATIONS = 128
ROWS = 6
SIMILARITY = 0.8
#: Multipliers that keep a shingle's words in order.
_MIXED = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(max(SHINGLE, ROWS))], np.uint64)


class _Words(dict):
    """A word's hash; forgotten all at once when there are many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 500_000:
            self.clear()
        h = xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text, as 32-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n <= SHINGLE:
        total = (h * _MIXED[:n]).sum(keepdims=True) + np.uint64(n)
    else:
        total = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            total += h[k : n - SHINGLE + 1 + k] * _MIXED[k]
    return np.unique((mix(total) >> np.uint64(32)).astype(np.uint32))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]


def signature(shingled: np.ndarray) -> np.ndarray:
    """The least value of each function, in 16 bits; all ones without shingles."""
    if not len(shingled):
        return np.full(PERMUTATIONS, 0xFFFF, np.uint16)
    a, b = _functions()
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingled), 2048):
        np.minimum(least, (shingled[None, i : i + 2048] * a + b).min(axis=1), out=least)
    # least values are small numbers: spread them before bits are dropped
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    least = (least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39)
    return np.minimum(least >> np.uint32(16), 0xFFFE).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def replaced(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many (or all) of the following text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


LEAST = -(2**63)


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next); `edited` is the edited text's sha256."""
    spark = docs.sparkSession
    many = 16 * partitions(spark)  # so many ranges that each task's share of them is about even
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(LEAST))
    bounds = docs.select(F.percentile_approx(key, [k / many for k in range(1, many)], 20 * many)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    def ranges(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            at = np.searchsorted(bounds, ids, side="right")
            first, end = runs(at[order := np.argsort(at, kind="stable")]) if len(at) else (np.empty(0, int), np.empty(0, int))
            least = [ids[order[s:e]].min() for s, e in zip(first, end)]
            yield pa.RecordBatch.from_arrays([pa.array([at[order[s]] for s in first], pa.int64()), pa.array(least, pa.int64())], names=["range", "first"])

    # a row per range that has documents: bounded by the number of ranges
    firsts = sorted(tuple(r) for r in docs.select(key.alias("k")).mapInArrow(ranges, "range long, first long").groupBy("range").agg(F.min("first")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    def deal(batches):
        for b in batches:
            ids = b.column(0).fill_null(LEAST).to_numpy()
            at = np.searchsorted(bounds, ids, side="right")
            again = np.flatnonzero([i in before for i in ids.tolist()])
            both = pa.Table.from_batches([b]).take(pa.array(np.r_[np.arange(len(ids)), again])).combine_chunks()
            both = both.append_column("range", pa.array(np.r_[at, [before[i] for i in ids[again].tolist()]].astype(np.int64)))
            both = both.append_column("tail", pa.array(np.r_[np.zeros(len(ids)), np.ones(len(again))].astype(bool)))
            yield from both.to_batches()

    dealt = docs.mapInArrow(tidy(deal), "doc_id long, text string, range long, tail boolean").repartition(partitions(spark), "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def follow(batches):
        last = None  # doc_id, text, range, tail, signature
        for b in batches:
            out = []
            for doc, text, where, tail in zip(*(c.to_pylist() for c in b.columns)):
                if tail and (last is None or last[2] != where or last[3]):
                    continue  # another row with the doc_id of the one that follows
                sig = signature(shingles(text))
                if last is not None and last[2] == where and not last[3]:
                    doc_, text_, _, _, sig_ = last
                    new = replaced(text_, text)
                    theirs = signature(shingles(new))
                    out.append((doc_, len(text_), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(sig_), shown(theirs), likeness(sig_, theirs), likeness(sig_, sig)))
                last = (doc, text, where, tail, sig)
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return dealt.mapInArrow(tidy(follow), "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


# --- near duplicates ------------------------------------------------------------------------------------------------

#: Rows of a bucket that one task compares with as many others.
BLOCK = 2000


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets without repeats; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = PERMUTATIONS // ROWS
    part = sig[: bands * ROWS].reshape(bands, ROWS).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64)
    for k in range(ROWS):
        total = total * np.uint64(0x100000001B3) + part[:, k] * _MIXED[k]
    return mix(total).view(np.int64)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): documents linked by chains of texts with that Jaccard similarity or more.

    1. Every text's bands are dealt out by their keys; in each bucket of several texts the smallest node meets all others.
    2. The shingle sets of texts in such buckets are made, once for equal texts, and those pairs are verified. Their links give
       a first set of components: most buckets now lie in one of them and are done.
    3. Buckets that don't are compared in blocks, pairs of different components only, and the links join the components.

    So what a large group of near copies costs is a star, and no two members of one component are compared for its sake.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))

    def sign(batches):
        for b in batches:
            keys = [band_keys(signature(shingles(t))) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["content", "keys"])

    signed = docs.select("content", "text").mapInArrow(tidy(sign), "content long, keys array<long>")
    keyed = materialise(signed.select(F.explode("keys").alias("key"), "content").distinct(), "bands")
    leaders = keyed.groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("z")).where("a <> z").select("key", "a")
    stars = materialise(keyed.join(leaders, "key").where("content <> a").select("a", F.col("content").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("content")).union(stars.select("b")).distinct()
    sets = materialise(_sets(docs.select("content", "text").join(wanted, "content", "left_semi")), "sets")
    both = stars.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def verify(batches):
        for b in batches:
            ok = [jaccard(*(np.frombuffer(v, np.uint32) for v in pair)) >= similarity for pair in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    first = materialise(components(both.select("a", "b", "x", "y").mapInArrow(tidy(verify), "a long, b long")), "first-components")
    named = keyed.join(leaders.select("key"), "key").join(first.withColumnRenamed("node", "content"), "content", "left").select("key", "content", F.coalesce("component", "content").alias("component"))
    open_ = named.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n")).where("p <> q").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = named.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    dealt = rest.select("key", "content", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "content", "component").join(sets.toDF("content", "s"), "content")
    links = dealt.select("key", "i", "j", "content", "component", "s").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "component").mapInArrow(tidy(_across(similarity)), "a long, b long")
    found = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    reps = docs.groupBy("content").agg(F.min("doc_id").alias("rep"))
    told = reps.join(found.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    least = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    return docs.select("doc_id", "content").join(told.join(least, "component").select("content", "component_id"), "content").select("doc_id", "component_id")


def _sets(docs: DataFrame) -> DataFrame:
    """(content, s): the shingles of each text, once for equal ones (they lie in one partition)."""

    def make(batches):
        seen: set[int] = set()
        for b in batches:
            ids, sets = [], []
            for c, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                if c not in seen:
                    seen.add(c)
                    ids.append(c)
                    sets.append(shingles(text).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["content", "s"])

    made = docs.select("content", "text").mapInArrow(tidy(make), "content long, s binary")
    return made.dropDuplicates(["content"])


def _across(similarity: float):
    """Rows sorted by bucket and block pair: links between members of different components, until those are one."""

    def bucket(rows):
        ids = [r[0] for r in rows]
        group = {r[1]: r[1] for r in rows}

        def root(g):
            while group[g] != g:
                group[g] = group[group[g]]
                g = group[g]
            return g

        sets = [np.frombuffer(r[2], np.uint32) for r in rows]
        for i in range(len(rows)):
            for j in range(i):
                p, q = root(rows[i][1]), root(rows[j][1])
                small, large = sorted((len(sets[i]), len(sets[j])))
                if p != q and small >= similarity * large and jaccard(sets[i], sets[j]) >= similarity:
                    group[p] = q
                    yield ids[i], ids[j]

    def run(batches):
        last, rows = None, []

        def out():
            found = list(bucket(rows)) if len({r[1] for r in rows}) > 1 else []
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, i, j, content, component, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != last:
                    yield from out()
                    last, rows = (key, i, j), []
                rows.append((content, component, s))
        yield from out()

    return run
