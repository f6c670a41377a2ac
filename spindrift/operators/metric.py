"""Exact similarity joins of vectors by metric pruning: cells around pivots, and pairs of cells that the triangle inequality rules out.

Unit vectors of cosine t or more are at most r = sqrt(2 - 2 t) apart. Each vector belongs to the cell of its nearest pivot and keeps its
distance to it. A vector can have a partner in another cell only if it is within r of that cell's farthest member, as seen from that
cell's pivot, and within 2 r of being as near to that pivot as to its own. It is copied to such cells of a smaller number, so a pair meets
once. Within a cell, rows sorted by distance to the pivot are compared only with those whose distance differs by r at most.

A cell of many rows is cut into ranges of distance of about BLOCK rows, each of which meets itself and the later ranges within r.
A task holds one range while what comes to it passes, unless distances are equal: equal vectors are one row here, with the ids as members (`copies`).

Where that rules out little, a row would be copied to most cells. If it came to more than COPIES of them, blocks meet instead, each pair in one
task; for classes such a task tells only what connects its rows, and the best pair of each.
What is compared is counted in `compared`, an accumulator, if one is given.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised
from .knn import BLOCK, DIGITS, blocked, close, held_then_passed, matrix

#: Vectors that pivots are chosen from, the most pivots, and the rows of a cell that is aimed at.
SAMPLE, PIVOTS, CELL = 4_096, 512, 1_000
#: Cells that a row may come to on average.
COPIES = 8
#: What distances and cosines of floats may be off by.
SLACK = 1e-6

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])


def copies(vectors: DataFrame) -> DataFrame:
    """(id, vector, members): equal vectors as one row with the smallest id and how many there are."""
    return vectors.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("members"))


def pivots(vectors: DataFrame, many: int) -> np.ndarray:
    """Vectors far from each other, of those with the smallest hashes: each the farthest from the ones before."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    m = np.array([r.vector for r in rows], np.float64)
    m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    chosen, far = [0], np.full(len(m), np.inf)
    while len(chosen) < min(many, len(m)):
        far = np.minimum(far, 2 - 2 * m @ m[chosen[-1]])
        k = int(far.argmax())
        if far[k] <= SLACK:  # the rest are copies of pivots
            break
        chosen.append(k)
    return m[chosen]


def _distances(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * m @ p.T))


def _told(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score)], schema=_PAIRS)


class Close:
    """Rows of a block that are close to rows which pass with a larger id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, threshold: float, compared: Accumulator | None):
        self.ids, self.rows, self.rough, self.threshold, self.compared = ids, rows, rows.astype(np.float32), threshold, compared

    def met(self, cids: np.ndarray, cm: np.ndarray):
        """(i, j, score): places of rows and of what passes."""
        if self.compared is not None:
            self.compared.add(len(self.ids) * len(cids))
        for s, f, i, j, score in close(self.rows, self.rough, cm, lambda s, rough, slack: self.threshold - slack):
            good = (np.round(score, DIGITS) >= self.threshold) & (self.ids[s + i] < cids[f + j])
            if good.any():
                yield s + i[good], f + j[good], score[good]

    def add(self, cids: np.ndarray, cm: np.ndarray):
        for i, j, score in self.met(cids, cm):
            yield _told(self.ids[i], cids[j], score)

    def found(self):
        return ()


class Connected(Close):
    """Of these pairs, those that connect rows which weren't, and the best of each row of the block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, threshold: float, compared: Accumulator | None):
        super().__init__(ids, rows, threshold, compared)
        self.up = np.arange(len(ids))
        self.best, self.partner = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)

    def _roots(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while True:
            above = self.up[root]
            if (above == root).all():
                self.up[at] = root
                return root
            root = above

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def add(self, cids: np.ndarray, cm: np.ndarray):
        before = len(self.up)
        self.up = np.r_[self.up, np.arange(before, before + len(cids))]
        for i, j, score in self.met(cids, cm):
            order = np.lexsort((score, i))
            last = order[np.r_[np.flatnonzero(np.diff(i[order])), len(i) - 1]]
            last = last[score[last] > self.best[i[last]]]
            self.best[i[last]], self.partner[i[last]] = score[last], cids[j[last]]
            a, b = self._roots(i), self._roots(before + j)
            _, one = np.unique(np.stack([a, b]), axis=1, return_index=True)
            new = []
            for n in one[a[one] != b[one]].tolist():
                x, y = self._root(a[n]), self._root(b[n])
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    new.append(n)
            if new:
                yield _told(self.ids[i[new]], cids[j[new]], score[new])

    def found(self):
        some = np.isfinite(self.best)
        yield _told(self.ids[some], self.partner[some], self.best[some])


def pairs(vectors: DataFrame, threshold: float, compared: Accumulator | None = None, classes: bool = False) -> DataFrame:
    """(a, b, score) of all a < b whose cosine is `threshold` or more, rounded to DIGITS; ids and vectors are distinct.

    With `classes` some pairs may be missing, but none that connects what the others don't, nor the best one of what they connect. `vectors` has id and vector. The threshold is positive, so vectors without a length have no partners.
    """
    if threshold <= 0:
        raise ValueError("metric pruning needs a positive threshold")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    vectors = materialised(vectors.select("id", "vector").where(squares > 0), "metric-vectors")
    n = vectors.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "a long, b long, score double")
    p = pivots(vectors, max(1, min(PIVOTS, n // CELL + 1)))

    def near(batches):
        for b in batches:
            d = _distances(matrix(b.column(1)), p)
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["id", "vector", "cell", "d"])

    homes = materialised(vectors.mapInArrow(near, "id long, vector array<double>, cell int, d double"), "metric-cells")
    sizes = {r.cell: (r.n, r.far) for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()}  # one row for each pivot at most
    far = np.array([sizes[c][1] if c in sizes else -np.inf for c in range(len(p))])

    def comes(d, home, own):
        return (d <= far + radius) & (d - own[:, None] <= 2 * radius) & (np.arange(len(p)) < home[:, None])

    def visits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(comes(_distances(matrix(b.column(1)), p), b.column(2).to_numpy(), b.column(3).to_numpy()).sum())])], names=["n"])

    if len(p) > COPIES and homes.mapInArrow(visits, "n long").agg(F.sum("n")).first()[0] > COPIES * n:
        kind = Connected if classes else Close
        met = blocked(vectors, vectors, lambda ids, m: kind(ids, m, threshold, compared), "a long, b long, score double")
        return met.distinct() if classes else met  # a best pair may have connected its rows as well
    # ranges of distance, about BLOCK rows each: one number for each of them travels with the tasks
    cuts, large = {}, [c for c, (many, _) in sizes.items() if many > BLOCK]
    if large:
        parts = -(-max(sizes[c][0] for c in large) // BLOCK)
        quantiles = F.percentile_approx("d", [i / parts for i in range(1, parts)], 100 * parts)
        for r in homes.where(F.col("cell").isin(large)).groupBy("cell").agg(quantiles.alias("at")).collect():
            own = -(-sizes[r.cell][0] // BLOCK)
            cuts[r.cell] = np.unique([r["at"][round(i * parts / own) - 1] for i in range(1, own)])

    def spread(batches):
        """Every row to its own range, and to each range that may have a partner of it and doesn't come to it."""
        for b in batches:
            ids, column, home, own = b.column(0), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
            d = _distances(matrix(column), p)
            row, cell = np.nonzero(comes(d, home, own))
            row, cell = np.r_[np.arange(len(home)), row], np.r_[home, cell]
            guest = np.r_[np.zeros(len(home), bool), np.ones(len(row) - len(home), bool)]
            dist = d[row, cell]
            out = []
            for c in np.unique(cell):
                here = np.flatnonzero(cell == c)
                bounds = cuts.get(int(c), np.empty(0))
                own_range = np.searchsorted(bounds, dist[here], "right")
                last = np.searchsorted(bounds, dist[here] + radius, "right")
                first = np.where(guest[here], np.searchsorted(bounds, dist[here] - radius, "right"), own_range)
                times = last - first + 1
                which = np.repeat(here, times)
                to = np.concatenate([np.arange(f, t + 1) for f, t in zip(first, last, strict=True)]) if len(here) else np.empty(0, np.int64)
                out.append((which, np.full(len(which), c), to, guest[which] | (to != np.repeat(own_range, times))))
            which, cells, to, guests = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
            rows = pa.array(row[which])
            for k in range(0, len(which), BLOCK):
                s = slice(k, k + BLOCK)
                yield pa.RecordBatch.from_arrays([ids.take(rows[s]), column.take(rows[s]), pa.array(cells[s].astype(np.int32)), pa.array(to[s].astype(np.int32)), pa.array(guests[s].astype(bool)), pa.array(dist[which[s]])], names=["id", "vector", "cell", "part", "guest", "d"])

    class Range:
        """A range's rows, by distance, that meet one another and then its guests, as they pass by distance."""

        def __init__(self, table: pa.Table):
            table = table.sort_by("d")
            self.ids, self.d, self.m = table["id"].to_numpy(), table["d"].to_numpy(), matrix(table["vector"].combine_chunks())

        def _met(self, ids, d, m, same):
            seen = 0
            for k in range(0, len(self.ids), 256):
                mine = self.d[k : k + 256]
                f = k if same else np.searchsorted(d, mine[0] - radius)
                t = np.searchsorted(d, mine[-1] + radius, "right")
                score = self.m[k : k + 256] @ m[f:t].T
                seen += score.size
                good = np.round(score, DIGITS) >= threshold
                if same:
                    good &= np.arange(score.shape[1]) > np.arange(len(mine))[:, None]
                i, j = np.nonzero(good)
                if len(i):
                    yield _told(self.ids[k + i], ids[f + j], score[i, j])
            if compared is not None:
                compared.add(seen)

        def add(self, b: pa.RecordBatch):
            ids, column, d = b.column(2).to_numpy(), b.column(3), b.column(4).to_numpy()
            for f in range(0, len(ids), BLOCK):
                yield from self._met(ids[f : f + BLOCK], d[f : f + BLOCK], matrix(column[f : f + BLOCK]), False)

        def found(self):
            yield from self._met(self.ids, self.d, self.m, True)

    dealt = homes.mapInArrow(spread, "id long, vector array<double>, cell int, part int, guest boolean, d double")
    many = 1 + max((len(c) for c in cuts.values()), default=0)
    task = (F.col("cell") * many + F.col("part")).alias("task")
    # a range without rows of its own has no pairs
    return held_then_passed(dealt.select(task, F.col("guest").cast("int").alias("side"), "id", "vector", "d"), len(p) * many, ["d"], Range, "a long, b long, score double")


def similar_pairs(corpus: DataFrame, threshold: float, id_: str = "id", vector: str = "vector", compared: Accumulator | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b with that cosine or more, copies of a vector among themselves included."""
    given = corpus.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    given = materialised(given, "pair-vectors")
    one = materialised(copies(given), "pair-distinct")
    near = pairs(one, threshold, compared)
    home = given.join(one.select(F.col("id").alias("home"), "vector", "members"), "vector").select("id", "home", "members")
    own = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 0
    same = given.where(own).join(one.where("members > 1").select(F.col("id").alias("home"), "vector"), "vector").select("id", "home")
    equal = same.alias("x").join(same.alias("y"), (F.col("x.home") == F.col("y.home")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("score"))
    # most vectors have no copy: their pairs pass without a join that multiplies
    left = home.select(F.col("home").alias("a"), F.col("id").alias("first"))
    right = home.select(F.col("home").alias("b"), F.col("id").alias("second"))
    across = near.join(left, "a").join(right, "b").select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), "score")
    return across.unionByName(equal)


def similar_classes(corpus: DataFrame, threshold: float, id_: str = "id", vector: str = "vector", compared: Accumulator | None = None) -> DataFrame:
    """(a, b, score): edges that connect what similar_pairs connects; each copy of a vector is tied to the smallest id of them only."""
    given = corpus.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    one = materialised(copies(given), "class-distinct")
    own = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 0
    tied = given.where(own).join(one.where("members > 1").select(F.col("id").alias("a"), "vector"), "vector").where("id > a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return pairs(one, threshold, compared, classes=True).unionByName(tied)
