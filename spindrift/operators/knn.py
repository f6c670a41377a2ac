"""Exact nearest neighbours by blocks: matrix products in Arrow batches, the k best of each task, then the k best of all.

Query vectors travel with the tasks after a check of their number; more of them are dealt out in blocks of HELD numbers, which a task
holds while a part of the corpus passes. Products are taken in single precision first; what comes near enough is taken again in double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that may travel with every task, and the fewest rows that are worth a part.
CARRIED = 5_000
BLOCK = 2_000
DIGITS = 9
#: Numbers of vectors that a task holds, and rows and columns of a product.
HELD = 4_000_000
ROWS, COLUMNS = 256, 4_096

HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, scaled to length 1; rows without length stay zero."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    width = offsets[1] - offsets[0] if len(column) else 0
    return normal(flat[offsets[0] : offsets[-1]].reshape(len(column), width))


def stacked(rows: list) -> np.ndarray:
    """Vectors of rows, scaled to length 1."""
    return normal(np.array([r.vector for r in rows], np.float64)) if rows else np.empty((0, 0))


def normal(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def knn(corpus: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "vector", exclude_self: bool = False, carried: int = CARRIED) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine of each query; ties go to the smaller id."""
    corpus, queries = _vectors(corpus, id_, vector), _vectors(queries, id_, vector)
    found = queries.limit(carried + 1).collect()
    if len(found) <= carried:
        ids = np.array([r.id for r in found], np.int64)
        rows = stacked(found)

        def search(batches):
            near = Nearest(ids, rows, k, exclude_self)
            for b in batches:
                if len(ids) and b.num_rows:
                    near.add(b.column(0).to_numpy(), matrix(b.column(1)))
            yield from near.found()

        part = corpus.mapInArrow(search, "query_id long, id long, score double")
    else:
        part = blocked(corpus, queries, lambda q, qm: Nearest(q, qm, k, exclude_self), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best hits so far of some queries: by score to DIGITS, then by id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score, self.hit = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def floor(self, s: int, rough: np.ndarray, slack: float, more: int = 0) -> np.ndarray:
        """What a score of the queries from `s` on must reach: their last one's or, of queries without k hits, that of the k-th (and `more`) of `rough`."""
        last = self.score[s : s + len(rough), -1] - slack
        few, k = np.isinf(last), self.k + more
        if few.any() and rough.shape[1] > k:
            last[few] = np.partition(rough[few], -k, axis=1)[:, -k] - slack
        return last

    def take(self, s: int, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Hits `ids` of the queries `s` + `i`."""
        key, last = np.round(score, DIGITS), np.round(self.score[s + i, -1], DIGITS)
        good = (key > last) | (key == last) & (ids < self.hit[s + i, -1])
        i, ids, score = i[good], ids[good], score[good]
        if not len(i):
            return
        old = np.unique(i)
        at, ids, score = np.r_[np.repeat(old, self.k), i], np.r_[self.hit[s + old].ravel(), ids], np.r_[self.score[s + old].ravel(), score]
        order = np.lexsort((ids, -np.round(score, DIGITS), at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        some = place < self.k
        self.hit[s + at[some], place[some]], self.score[s + at[some], place[some]] = ids[order][some], score[order][some]

    def found(self):
        for s in range(0, len(self.ids), 1_000):
            there = np.isfinite(self.score[s : s + 1_000])
            q = np.broadcast_to(self.ids[s : s + 1_000, None], there.shape)[there]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.hit[s : s + 1_000][there]), pa.array(self.score[s : s + 1_000][there])], schema=HITS)


def close(rows: np.ndarray, rough: np.ndarray, corpus: np.ndarray, floor):
    """(s, f, i, j, score): of products of ROWS rows from `s` on and COLUMNS vectors from `f` on those that reach floor(s, product, slack)."""
    slack = max(1e-5, 2.5e-7 * rows.shape[1])  # twice what single precision may be off by
    for f in range(0, len(corpus), COLUMNS):
        exact = corpus[f : f + COLUMNS]
        single = exact.astype(np.float32).T
        for s in range(0, len(rows), ROWS):
            score = rough[s : s + ROWS] @ single
            i, j = np.nonzero(score >= floor(s, score, slack))
            if len(i) * rows.shape[1] > score.size:
                yield s, f, i, j, (rows[s : s + ROWS] @ exact.T)[i, j]
            elif len(i):
                yield s, f, i, j, np.einsum("ij,ij->i", rows[s + i], exact[j])


class Nearest(Best):
    """The k nearest so far of some query vectors, as batches of the corpus pass."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, exclude_self: bool):
        super().__init__(ids, k)
        self.rows, self.rough, self.exclude_self = rows, rows.astype(np.float32), exclude_self

    def add(self, cids: np.ndarray, cm: np.ndarray) -> tuple:
        for s, f, i, j, score in close(self.rows, self.rough, cm, lambda s, rough, slack: self.floor(s, rough, slack, self.exclude_self)[:, None]):
            other = cids[f + j] != self.ids[s + i] if self.exclude_self else slice(None)
            self.take(s, i[other], cids[f + j][other], score[other])
        return ()


def tasks_for(df: DataFrame, blocks: int, rows: int) -> int:
    """Parts of a table that passes so many blocks: as many tasks as keep all cores busy, unless there is too little for them."""
    return max(1, min(-(-rows // BLOCK), -(-2 * df.sparkSession.sparkContext.defaultParallelism // blocks)))


def held_then_passed(rows: DataFrame, tasks: int, order: list[str], begin, types: str) -> DataFrame:
    """Rows (task, side, ...) by task, side 0 first: begin(table of side 0) gives what takes the batches of side 1 by `add` and tells what it `found`."""

    def run(batches):
        task, held, own = None, [], None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for f, t in zip(cuts[:-1], cuts[1:]):
                if f == t:
                    continue
                if key[f] // 2 != task:
                    if held:
                        own = begin(pa.Table.from_batches(held).combine_chunks())
                    if own is not None:
                        yield from own.found()
                    task, held, own = key[f] // 2, [], None
                part = b.slice(f, t - f)
                if key[f] % 2 == 0:
                    held.append(part)
                elif held or own is not None:
                    if own is None:
                        own, held = begin(pa.Table.from_batches(held).combine_chunks()), []
                    yield from own.add(part)
        if held:
            own = begin(pa.Table.from_batches(held).combine_chunks())
        if own is not None:
            yield from own.found()

    return rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "side", *order).mapInArrow(run, types)


def blocked(passing: DataFrame, held: DataFrame, begin, types: str) -> DataFrame:
    """Every part of `passing` past every block of `held`: begin(ids, vectors) of a block gives what takes the parts by add(ids, vectors) and tells what it `found`."""
    n, width = held.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (width or 1) // HELD))
    parts = tasks_for(held, blocks, passing.count())
    hashed = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    cell = (F.col("i") * parts + F.col("j")).alias("task")
    a = held.select(hashed(blocks).alias("i"), every(parts).alias("j"), "id", "vector").select(cell, F.lit(0).alias("side"), "id", "vector")
    b = passing.select(every(blocks).alias("i"), hashed(parts).alias("j"), "id", "vector").select(cell, F.lit(1).alias("side"), "id", "vector")

    class Met:
        def __init__(self, table: pa.Table):
            self.own = begin(table.column(2).to_numpy(), matrix(table.column(3).chunk(0)))

        def add(self, b: pa.RecordBatch):
            return self.own.add(b.column(2).to_numpy(), matrix(b.column(3)))

        def found(self):
            return self.own.found()

    return held_then_passed(a.union(b), blocks * parts, [], Met, types)


def hubness(corpus: DataFrame, k: int = 10, id_: str = "id", vector: str = "vector") -> DataFrame:
    """(id, r): the mean of each row's k largest cosines to others, k between 1 and the number of others; 0 for an only row."""
    vectors = _vectors(corpus, id_, vector)
    near = knn(vectors, vectors, k, exclude_self=True)
    mean = near.groupBy(F.col("query_id").alias("id")).agg(F.avg("score").alias("r"))
    return vectors.select("id").join(mean, "id", "left").na.fill(0.0, ["r"])
