"""Exact substring dedup by suffix arrays over anchored buckets, ordered by deep-shallow sorting.

A string of `length` bytes that starts in two places is removed in both. The suffix array is never built as a whole:

- anchors (module `anchors`): the leftmost minimum of the hashes of K-byte grams in a string selects where the string is
  filed, so equal strings are filed under equal hashes, at equal distance from their anchor;
- a bucket holds the segments around one anchor hash; a string in it is the j bytes left of the anchor and the
  length - j bytes right of it;
- the bucket's right halves and its mirrored left halves are each put in suffix order by deep-shallow sorting:
  multikey quicksort, eight bytes a step, down to a shallow depth; then the groups that still share their prefix are
  ordered by blind tries, which look at the branching bytes only. Common prefixes of neighbours then tell which halves
  are equal at every j, and a string is repeated iff another has both halves equal.

Hashes only select candidates; every equality is decided on bytes.

Buckets of anchors in more than `hot` places are not gathered and not sorted: their distinct segments are, their strings
counted one by one in Spark as bytes, and the repeated ones joined back to the segments they are in.

Cases: null is the empty text; a text shorter than `length` loses nothing; equal rows are each other's copies; bytes
are those of UTF-8, so what is left need not be valid UTF-8 and is binary; an empty table gives an empty result; columns
that clash with the result's are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import leftmost_minima, mix, random_u64, runs, tidy

LENGTH = 200
GRAM = 40
#: Depth in bytes at which multikey quicksort hands over to blind tries.
SHALLOW = 64
#: Places of an anchor beyond which its bucket is not gathered in one task.
HOT = 30_000


# --- sorting --------------------------------------------------------------------------------------------------------


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of distinct strings of equal length, by a blind trie: inner nodes are (depth, {byte: child}), leaves are indices."""
    root: int | list = 0
    for i in range(1, len(strings)):
        s = strings[i]
        node = _leaf(root, s)
        t = strings[node]
        depth = next(d for d in range(len(s)) if s[d] != t[d])
        parent, node = None, root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = i
            continue
        new = [depth, {t[depth]: node, s[depth]: i}]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def _leaf(node, s: bytes) -> int:
    """The leaf that the branching bytes lead to; where one leads nowhere, any leaf below shares the same prefix."""
    while not isinstance(node, int):
        children = node[1]
        node = children[s[node[0]]] if s[node[0]] in children else next(iter(children.values()))
    return node


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order of byte strings (rows of a matrix, a multiple of 8 wide) within each group; `group` ascends."""
    n, width = rows.shape
    words = rows.view(">u8").astype(np.uint64)
    order = np.arange(n)
    rank = group.copy()  # of the place in `order`: the class so far
    for w in range(min(SHALLOW, width) // 8):
        first = np.r_[True, rank[1:] != rank[:-1]]
        open_ = np.flatnonzero(~(first & np.r_[first[1:], True]))  # in classes of several
        if not len(open_):
            return order
        key = words[order[open_], w]
        at = np.lexsort((key, rank[open_]))
        key, cls = key[at], rank[open_][at]
        order[open_] = order[open_][at]
        split = np.zeros(n, np.int64)
        split[open_[1:]] = (cls[1:] == cls[:-1]) & (key[1:] != key[:-1])
        rank = rank + np.cumsum(split)
    starts, ends = runs(rank)
    deep = np.flatnonzero(ends - starts > 1)
    data = rows.tobytes()
    depth = min(SHALLOW, width) // 8 * 8
    for s, e in zip(starts[deep].tolist(), ends[deep].tolist()):
        members = order[s:e].tolist()
        same: dict[bytes, list[int]] = {}
        for m in members:
            same.setdefault(data[m * width + depth : (m + 1) * width], []).append(m)
        strings = list(same)
        if len(strings) > 1:
            strings = [strings[i] for i in blind_trie_order(strings)]
        order[s:e] = [m for x in strings for m in same[x]]
    return order


def neighbours(group: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each row with the one before it in `order`; -1 for the first of a group."""
    differ = rows[order[1:]] != rows[order[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    lcp[group[order[1:]] != group[order[:-1]]] = -1
    return np.r_[-1, lcp].astype(np.int32)


def compare_for(length: int):
    """For a chunk of segments: which of their strings of `length` bytes occur twice, as one interval around the anchor each."""

    def compare(group, left, segments, n, doc):
        many = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
        alone = (many[group] == 1) & (n == 1)
        left = left.astype(np.int64)
        size = np.array([len(s) for s in segments], np.int64)
        low = left - (size - length)  # the string that starts last has so many bytes left of the anchor
        done = (many[group] == 1) & (n > 1)
        idx = np.flatnonzero(~alone & ~done)
        found = [np.flatnonzero(done)]
        least, most = [low[done]], [left[done]]
        if len(idx):
            g = np.unique(group[idx], return_inverse=True)[1]
            m, lefts, lows, weight = len(idx), left[idx], low[idx], n[idx]
            wide = -(-length // 8) * 8
            right_rows, left_rows = np.zeros((m, wide), np.uint8), np.zeros((m, wide), np.uint8)
            for k, i in enumerate(idx.tolist()):
                s, at = segments[i], int(left[i])
                tail, head = s[at : at + length], s[:at][::-1]
                right_rows[k, : len(tail)] = np.frombuffer(tail, np.uint8)
                left_rows[k, : len(head)] = np.frombuffer(head, np.uint8)
            depths = []
            for rows in (left_rows, right_rows):
                order = deep_shallow(g, rows)
                lcp = neighbours(g, rows, order)
                depths.append((order, lcp))
            lo, hi = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
            cls = np.empty((2, m), np.int64)
            for j in range(int(lows.min()), int(lefts.max()) + 1):
                on = np.flatnonzero((lows <= j) & (j <= lefts))
                if not len(on):
                    continue
                for side, (order, lcp), depth in zip((0, 1), depths, (j, length - j)):
                    cls[side, order] = np.cumsum(lcp < depth)
                key = cls[0, on] * (m + 1) + cls[1, on]
                at = np.argsort(key, kind="stable")
                key = key[at]
                first = np.r_[True, key[1:] != key[:-1]]
                starts = np.flatnonzero(first)
                total = np.add.reduceat(weight[on[at]], starts)
                again = on[at][(total >= 2)[np.cumsum(first) - 1]]
                hi[again] = j
                lo[again[lo[again] < 0]] = j
            some = lo >= 0
            found.append(idx[some])
            least.append(lo[some])
            most.append(hi[some])
        which = np.concatenate(found)
        return which, -np.concatenate(most), length - np.concatenate(least), doc[which]

    return compare


# --- anchors --------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` bytes: differences of prefix sums of a polynomial modulo 2^64."""
    n = len(data)
    up, down = _powers(max(1 << 17, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(random_u64(256, 3)[data] * up[:n], out=total[1:])
    return mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])


def selected(text: str, length: int, gram: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes; and for each anchor its hash, its place, and the first and last string that is filed there."""
    data = text.encode("utf-8", "surrogatepass")
    none = np.empty(0, np.int64)
    if len(data) < length:
        return data, none.view(np.uint64), none, none, none
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    at = leftmost_minima(h, length - gram + 1)
    first, end = runs(at)
    at = at[first]
    return data, h[at], at, first, end - 1


def cut_for(length: int, gram: int):
    def cut(text, hashes):
        data, h, at, first, last = selected(text, length, gram)
        h = h.view(np.int64)
        keep = np.flatnonzero(np.isin(h, hashes))
        found: dict = {}
        for i, a, s, e in zip(h[keep].tolist(), at[keep].tolist(), first[keep].tolist(), (last[keep] + length).tolist()):
            found.setdefault((i, a - s, data[s:e]), []).append(a)
        for (i, left, seg), places in found.items():
            sure = None
            if len(places) > 1:
                sure = np.array([(a - left, a - left + len(seg)) for a in places[1:]], np.int32).tobytes()
            yield i, left, seg, len(places), places[0], sure

    return cut


# --- the operator ---------------------------------------------------------------------------------------------------


def _hot_intervals(found: DataFrame, length: int) -> DataFrame:
    """(row, start, end) of segments in buckets that aren't gathered: strings counted by value, the repeated ones joined back."""
    known = found.where("left < 0").select(F.col("docs")[0].alias("row"), F.explode(F.expr("transform(sequence(0, length(segment) div 8 - 1), i -> substring(segment, 8 * i + 1, 8))")).alias("span"))

    def whole(at: int):  # a little-endian int of the span
        return F.conv(F.hex(F.concat(*[F.expr(f"substring(span, {at + k}, 1)") for k in (4, 3, 2, 1)])), 16, 10).cast("int")

    known = known.select("row", whole(0).alias("start"), whole(4).alias("end"))
    found = found.where("left >= 0")
    segments = found.groupBy("h", "left", "segment").agg(F.sum("n").alias("n"))
    strings = segments.select("h", "left", "segment", "n", F.explode(F.sequence(F.lit(0), F.length("segment") - length)).alias("i"))
    strings = strings.select("h", "left", F.xxhash64("segment").alias("s"), "n", "i", F.expr(f"substring(segment, i + 1, {length})").alias("string"))
    twice = strings.groupBy("string").agg(F.sum("n").alias("all")).where("all >= 2").select("string")
    spans = strings.join(twice, "string", "left_semi").groupBy("h", "left", "s").agg(F.min("i").alias("lo"), (F.max("i") + length).alias("hi"))
    places = found.select("h", "left", F.xxhash64("segment").alias("s"), F.explode(F.arrays_zip("docs", "at")).alias("x"))
    joined = places.join(spans, ["h", "left", "s"])
    return known.union(joined.select(F.col("x.docs").alias("row"), (F.col("x.at") - F.col("left") + F.col("lo")).cast("int").alias("start"), (F.col("x.at") - F.col("left") + F.col("hi")).cast("int").alias("end")))


KEPT = pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each row without the bytes of strings that start twice in the corpus."""
    docs = A.rows_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    repeated = A.repeated_anchors(docs, lambda text: selected(text, length, gram)[1], hot)
    gathered, counted = (A.segments(docs, repeated.where(which), cut_for(length, gram)) for which in ("not hot", "hot"))
    intervals = A.compared(gathered, compare_for(length)).drop("first").union(_hot_intervals(counted, length))

    def keep(batches):
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = (text or "").encode("utf-8", "surrogatepass")
                start, end = A.unpacked(spans)
                kept = b"".join(data[s:e] for s, e in zip([0, *end.tolist()], [*start.tolist(), len(data)]))
                out.append((doc, len(data), len(data) - len(kept), len(start), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), KEPT)], schema=KEPT) if out else pa.RecordBatch.from_pylist([], schema=KEPT)

    return A.with_spans(docs, intervals).select("doc_id", "text", "spans").mapInArrow(tidy(keep), "row long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("row", "doc_id")
