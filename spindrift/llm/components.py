"""Connected components over an edge table of any size, by large-star and small-star rounds.

No links, labels or components reach the driver, only the count that tells whether a round changed anything. Before the
first round every task contracts its own edges by union-find, so that long chains and dense groups need few rounds. A
round's table is written to the shared folder, so that a lost executor costs no more than that round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that aren't the smallest of their component, and that smallest node (vectorised hooking)."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            break
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    rest = parent != np.arange(len(nodes))
    return nodes[rest], nodes[parent[rest]]


#: Links that a task holds before they shrink to a forest.
HELD = 500_000
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def contract(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) as stars: every node linked to the smallest one of its component there."""

    def stars(batches):
        held, many = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            many += x.num_rows
            if many > HELD:
                held = [forest(*map(np.concatenate, zip(*held)))]
                many = len(held[0][0]) // 2  # a forest that doesn't shrink may grow by as much again
        a, b = forest(*map(np.concatenate, zip(*held))) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], schema=EDGES)

    return edges.select("a", "b").mapInArrow(tidy(stars), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b), the smallest node that it reaches."""
    now = materialise(contract(edges.where("a <> b")), "links")
    before = _state(now)
    while before[0]:
        # large star: a node's larger neighbours go to its smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node's smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(contract(small), "links")
        state = _state(now)
        if state == before:  # every component is one star already
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Two tables with the same edges agree in this, others hardly ever."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
