"""Near-duplicate passages by compact windows.

A text's tokens are its five-word shingles (A-Z in lower case, cut at ASCII white space). For each of `HASHES` hash
functions a Cartesian tree over the tokens' hashes gives the compact windows: for every token c that is the least in some
passage of at least `width` tokens, the widest range (l, c, r) in which it is the least. All passages within l..r that
hold c share c's hash as their min-hash, so there are about 2 n / width windows instead of n^2 passages. Where a token
repeats, some of its places stand for all (`thinned`).

Intervals are joined across hashes: two passages are candidates if at least `ENOUGH` of their min-hashes are equal.

1. The windows' hashes that a single text has fall away (module `anchors`).
2. In each text the windows of different functions that are left are intersected: a window stays if some passage lies in
   it and in the windows of `ENOUGH` - 1 other functions (passages of the lengths `SCALES`, times `width`).
3. Windows of equal hash meet in one bucket, with the words around c up to l and r, at most `REACH` tokens to a side. Passages
   that share `ENOUGH` of the functions share one of any HASHES - ENOUGH + 1, so only the windows of so many are sent.
4. In a bucket equal contexts are one node. Tokens that no other node has say how far a node can have a partner at all; nodes
   meet in order of doc_id for as long as a token that they share with others isn't in a passage found already. A pair's shared tokens
   are counted as sets, whatever their order or place: passages that begin and end with a shared token are near duplicates
   if the Jaccard similarity of their token sets is `similarity` or more and as many of their places are shared as two
   passages of `words` words share that are just alike (41 of 46).

Words are compared by 16 bits of their hash: one that is changed goes unnoticed with a probability of 2^-16, and a passage is
found where none is only if that happens to several words of it. Equal passages have equal min-hashes and are never missed. Others of similarity s are met with a probability of
s^3 + 3 s^2 (1 - s) at least (0.90 at 0.8, 0.97 at 0.9); tests measure it. A passage that reaches more than `REACH` tokens from
its least token on one side is compared as far as that.

What a passage's first document is (the smallest doc_id with a near duplicate of it) comes with each interval, so that
one of each class of passages can stay.

Cases: null is the empty text; texts shorter than `width` tokens have no passage; passages are compared across documents
only: a text that repeats itself isn't one; rows with equal doc_id are near duplicates of each other but neither
comes first; a null doc_id comes last; an empty table gives an empty result; further columns of any name are carried along
by `deduplicated` and ignored by `passages`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import PLACE, carried, merged, mix, partitions, random_u64, restored, sliding_min, tidy
from .words import SHINGLE, portions, shingles, word_hashes

#: Words of the shortest passage.
WORDS = 50
SIMILARITY = 0.8
HASHES = 3
#: Functions that have to agree.
ENOUGH = 2
#: Tokens of context on either side of the least one.
REACH = 92
#: Lengths of passages at which windows are intersected, in widths.
SCALES = (1, 1.4, 2)
#: Bytes of text that are hashed at once, of contexts that a task holds before it writes them out or compares them.
PORTION, HELD, COMPARED = 1_000_000, 6_000_000, 3_000_000
#: Nodes of a bucket up to which all may meet; of a larger one, those that all others meet; entries of the tables of a block of pairs.
LISTED, LEADERS, TABLE = 128, 16, 3_000_000
#: Of a large bucket: nodes that list partners at once, partners that each meets first, others that are told at once.
LISTERS, FIRST, OTHERS = 64, 8, 2_000


# --- windows --------------------------------------------------------------------------------------------------------


def compact_windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all ranges of at least `width` tokens of one row with their least one, by c; equal least ones share their range.

    The tree is built over candidates only: tokens that are the leftmost least of some `width` tokens. A window of at least
    `width` is bounded by such tokens alone: whatever bounds it is less than c and so the least of all that c is the least of.
    `row` ascends; it says whose token each is.
    """
    n = len(h)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none
    placed = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    within = row[width - 1 :] == row[: n - width + 1]
    at = (sliding_min(placed, width)[within] & PLACE).astype(np.int64)
    return tree(h, distinct(at), row)


def distinct(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.r_[True, ascending[1:] != ascending[:-1]]] if len(ascending) else ascending


def tree(h: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the candidates `at`: each one's smaller neighbours, its ancestors in the Cartesian tree, bound it.

    All candidates climb at once: whoever meets one that isn't smaller goes on to where that one has got to already.
    """
    v, owner = h[at] & ~PLACE, row[at]
    m = len(at)
    if not m:
        return at, at, at
    first, last = np.searchsorted(row, owner), np.searchsorted(row, owner, side="right") - 1
    bounds = []
    for order in (1, -1):
        value, whose = v[::order], owner[::order]
        up = np.arange(m) - 1
        climbing = np.arange(m)
        while True:
            p = up[climbing]
            climbing = climbing[(p >= 0) & (whose[p] == whose[climbing]) & (value[p] >= value[climbing])]
            if not len(climbing):
                break
            up[climbing] = up[up[climbing]]
        stop = (up >= 0) & (whose[up] == whose)
        bounds.append((up[::order], stop[::order]))
    (left, bounded), (right, stopped) = bounds
    right = m - 1 - right  # counted from the end
    return np.where(bounded, at[left] + 1, first), at, np.where(stopped, at[np.minimum(right, m - 1)] - 1, last)


def thinned(l: np.ndarray, c: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Which windows are enough where a token repeats: every passage of `width` tokens in (l, r) that holds one of its places
    holds one that stays, as places are dropped only where the one before or after is near."""
    if not len(c):
        return c
    order = np.lexsort((c, l, key))
    l, c, key = l[order], c[order], key[order]
    same = (l[1:] == l[:-1]) & (key[1:] == key[:-1])
    block = (c - l) // (width // 4)
    drop = np.r_[False, same & (block[1:] == block[:-1])] & np.r_[same & (c[1:] - c[:-1] <= width // 2), False]
    return np.sort(order[~drop])


def functions(s: np.ndarray) -> Iterator[np.ndarray]:
    for seed in random_u64(HASHES, 29):
        yield mix(s ^ seed)


def keys(column, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, index of the row) of the least tokens of a column's texts, each once a row."""
    for first, data, ends in portions(column, PORTION):
        s, row, _ = shingles(*word_hashes(data, ends))
        n = len(s)
        if n < width:
            continue
        within = row[width - 1 :] == row[: n - width + 1]
        place = np.arange(n, dtype=np.uint64)
        found, whose = [], []
        for h in functions(s):
            at = distinct((sliding_min((h & ~PLACE) | place, width)[within] & PLACE).astype(np.int64))
            found.append(h[at].view(np.int64))
            whose.append(row[at])
        h, whose = np.concatenate(found), np.concatenate(whose)
        order = np.lexsort((whose, h))
        h, whose = h[order], whose[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])] if len(h) else np.empty(0, bool)
        yield h[new], whose[new] + first


def widened(least: np.ndarray, width: int, size: int) -> np.ndarray:
    """Minima of windows of `size`, from those of `width`."""
    while width < size:
        step = min(width, size - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def contexts(column, repeated: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, index of the row, place of the anchor, left, size, words) of a column's windows that may hold a near duplicate.

    `repeated`: hashes that several texts have, ascending; `left`: words before the anchor; `words`: 16 bits for each of the
    `size` words of a context, one context after another.
    """
    for first, data, ends in portions(column, PORTION):
        w, owner = word_hashes(data, ends)
        s, row, word = shingles(w, owner)
        n = len(s)
        if n < width or not len(repeated):
            continue
        place = np.arange(n, dtype=np.uint64)
        hashes, least, known = [], [], []
        for h in functions(s):
            m = sliding_min((h & ~PLACE) | place, width)
            at = distinct((m & PLACE).astype(np.int64))
            theirs = h[at].view(np.int64)
            flag = np.zeros(n, bool)
            flag[at] = repeated[np.minimum(np.searchsorted(repeated, theirs), len(repeated) - 1)] == theirs
            hashes.append(h)
            least.append(m)
            known.append(flag)
        stays = np.zeros((HASHES - ENOUGH + 1, n), bool)
        for scale in SCALES:
            size = int(width * scale)
            if size > n:
                break
            ats = [(widened(m, width, size) & PLACE).astype(np.int64) for m in least]
            agree = sum(flag[at].view(np.int8) for flag, at in zip(known, ats)) >= ENOUGH
            agree &= row[size - 1 :] == row[: n - size + 1]
            for stay, flag, at in zip(stays, known, ats):
                at = at[agree]
                stay[at[flag[at]]] = True
        within = row[width - 1 :] == row[: n - width + 1]
        for stay, h, m in zip(stays, hashes, least):
            l, c, r = tree(h, distinct((m[within] & PLACE).astype(np.int64)), row)
            keep = np.flatnonzero(stay[c])
            if not len(keep):
                continue
            keep = keep[thinned(l[keep], c[keep], h[c[keep]], width)]
            c = c[keep]
            l, r = np.maximum(l[keep], c - REACH), np.minimum(r[keep], c + REACH)
            size = r - l + SHINGLE
            flat = np.repeat(word[l] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            yield h[c].view(np.int64), row[c] + first, word[c] - np.searchsorted(owner, row[c]), c - l, size, (w[flat] >> np.uint64(48)).astype("<u2")


# --- from texts to buckets ------------------------------------------------------------------------------------------

SEGMENTS = pa.schema([("h", pa.int64()), ("left", pa.int32()), ("segment", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("docs", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
_SEGMENTS = "h long, left int, segment binary, n long, least long, docs array<long>, at array<int>"


def segments_of(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each context: `words` holds one after another."""
    begin = np.r_[0, np.cumsum(size)[:-1]]
    within = np.arange(len(words)) - np.repeat(begin, size)
    return mix(np.add.reduceat((words.astype(np.uint64) + np.uint64(1)) * random_u64(2 * REACH + SHINGLE, 31)[within], begin))


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, one after another."""
    return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)


def _lists(values: np.ndarray, starts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values, kind))


def _binary(words: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(2 * size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words))])


def collected(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(h, row, doc, at, left, size, words) with equal contexts as one row of SEGMENTS."""
    h, row, doc, at, left, size, words = (np.concatenate(x) for x in zip(*held))
    same = segments_of(words, size)
    order = np.lexsort((row, same, left, h))
    h_, left_, same_, row_ = h[order], left[order], same[order], row[order]
    new = np.r_[True, (h_[1:] != h_[:-1]) | (left_[1:] != left_[:-1]) | (same_[1:] != same_[:-1])]
    start = np.flatnonzero(new)
    other = new | np.r_[True, row_[1:] != row_[:-1]]
    many, least = np.add.reduceat(other.astype(np.int64), start), np.minimum.reduceat(doc[order], start)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    ends = np.r_[start[1:], len(order)]
    for i in range(0, len(start), 10_000):
        s, e = start[i : i + 10_000], ends[i : i + 10_000]
        one = order[s]
        inside = order[s[0] : e[-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h_[s]), pa.array(left_[s].astype(np.int32)), _binary(words[ragged(begin[one], size[one])], size[one]), pa.array(many[i : i + 10_000]), pa.array(least[i : i + 10_000]), _lists(row[inside], s - s[0], pa.int64()), _lists(at[inside].astype(np.int32), s - s[0], pa.int32())],
            schema=SEGMENTS,
        )


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(row, hs): the hashes of a row's windows that other rows have too."""

    def emit(batches):
        held, size = [], 0
        for b in batches:
            rows = b.column(0).to_numpy()
            for h, index in keys(b.column(1), width):
                held.append((h, rows[index]))
                size += len(h)
                if size > A.HELD:
                    yield from A.by_hash(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from A.by_hash(*map(np.concatenate, zip(*held)))

    return A.in_several(docs.select("row", "text").mapInArrow(tidy(emit), "h long, docs array<long>"))


def segments(docs: DataFrame, repeated: DataFrame, width: int) -> DataFrame:
    def emit(batches):
        held, size = [], 0
        for b in batches:
            row, text, hs, doc = (b.column(b.schema.get_field_index(c)) for c in ("row", "text", "hs", "doc_id"))
            row, doc = row.to_numpy(), doc.cast(pa.int64()).fill_null(A.LAST).to_numpy()
            for h, index, at, left, many, words in contexts(text, np.unique(hs.flatten().to_numpy()), width):
                held.append((h, row[index], doc[index], at, left, many, words))
                size += words.nbytes
                if size > HELD:
                    yield from collected(held)
                    held, size = [], 0
        if held:
            yield from collected(held)

    # all columns come along, so that the exchange of the documents is the one that with_spans reads
    joined = docs.join(repeated.hint("shuffle_hash"), "row")
    return joined.select(*docs.columns, "hs").mapInArrow(tidy(emit), _SEGMENTS)


# --- buckets --------------------------------------------------------------------------------------------------------


class Holders:
    """Where each node has each token of a bucket: a row of places for a token that many have, a list for one that few have."""

    def __init__(self, ids: np.ndarray):
        m, tokens = len(ids), int(ids.max(initial=-1)) + 1
        line, column = np.nonzero(ids >= 0)
        key, one = np.unique(ids[line, column].astype(np.int64) * m + line, return_index=True)
        self.line, self.column = key % m, (column[one] + 1).astype(np.uint8)
        self.start = np.searchsorted(key, np.arange(tokens + 1) * m)
        common = np.flatnonzero(np.diff(self.start) > m // 16)
        self.row = np.full(tokens, -1)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), m), np.uint8)
        for row, token in zip(self.common, common.tolist()):
            of = slice(self.start[token], self.start[token + 1])
            row[self.line[of]] = self.column[of]

    def places(self, tokens: np.ndarray, first: int, last: int) -> np.ndarray:
        """For each token, where nodes `first` to `last` have it, counted from 1; 0 where they don't."""
        row = self.row[tokens]
        at = np.zeros((len(tokens), last - first), np.uint8)
        at[row >= 0] = self.common[row[row >= 0], first:last]
        few = np.flatnonzero(row < 0)
        many = self.start[tokens[few] + 1] - self.start[tokens[few]]
        entry = ragged(self.start[tokens[few]], many)
        line = self.line[entry] - first
        on = (line >= 0) & (line < last - first)
        at[np.repeat(few, many)[on], line[on]] = self.column[entry[on]]
        return at


def running(function: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The same as function.accumulate(values), row by row."""
    out = np.array(values)
    for k in range(1, len(out)):
        function(out[k - 1], out[k], out=out[k])
    return out


class Bucket:
    """Nodes (distinct contexts) of some buckets as matrices, the anchor in column `REACH`.

    `group` ascends. `id`: a token's number within its bucket where two nodes have it, else -1; `prev`: where the node has the same
    token before, -1 for nowhere; `first`: the smallest doc_id that a near duplicate of a passage around here has.
    """

    WIDE = 2 * REACH + 1

    def __init__(self, group, left, size, words, n, least, width: int, similarity: float):
        self.group, self.n, self.least, self.width, self.similarity = group, n, least, width, similarity
        m = len(group)
        size = size - SHINGLE + 1  # in tokens
        begin = REACH - left
        column = np.arange(self.WIDE)
        self.there = (column >= begin[:, None]) & (column < (begin + size)[:, None])
        padded = np.zeros((m, self.WIDE + SHINGLE - 1), np.uint16)
        column = np.arange(self.WIDE + SHINGLE - 1)
        padded[(column >= begin[:, None]) & (column < (begin + size + SHINGLE - 1)[:, None])] = words
        token = padded[:, : self.WIDE].astype(np.uint64)
        for k in range(1, SHINGLE):
            token = token * np.uint64(0x9E3779B97F4A7C15) + padded[:, k : k + self.WIDE]
        token = mix(token)
        # tokens in order, a run of equal ones as one: what nodes are alike in as a whole
        turn = self.there.copy()
        turn[:, 1:] &= (token[:, 1:] != token[:, :-1]) | ~self.there[:, :-1]
        self.outline = np.where(turn, token * random_u64(self.WIDE, 37)[np.cumsum(turn, axis=1) - 1], 0).sum(axis=1, dtype=np.uint64)
        at = np.flatnonzero(self.there)
        bucket = np.cumsum(np.r_[0, group[1:] != group[:-1]])
        node = at // self.WIDE
        value = token.ravel()[at] >> np.uint64(20) | bucket[node].astype(np.uint64) << np.uint64(44)
        order = np.argsort(value, kind="stable")
        value, at = value[order], at[order]
        node = at // self.WIDE
        new = np.r_[True, value[1:] != value[:-1]]
        other = new | np.r_[True, node[1:] != node[:-1]]
        start = np.flatnonzero(new)
        holders = np.add.reduceat(other.astype(np.int64), start)
        shared = holders > 1
        base = bucket[node[start]]
        number = np.cumsum(shared) - 1
        number -= np.r_[0, np.cumsum(shared)][np.searchsorted(base, base)]
        which = np.cumsum(new) - 1
        self.id = np.full(m * self.WIDE, -1, np.int32)
        self.id[at] = np.where(shared[which], number[which], -1)
        self.id = self.id.reshape(m, self.WIDE)
        self.prev = np.full(m * self.WIDE, -1, np.int16)
        again = np.flatnonzero(~other)
        self.prev[at[again]] = (at[again - 1] % self.WIDE).astype(np.int16)
        self.prev = self.prev.reshape(m, self.WIDE)
        self.holders = np.zeros(m * self.WIDE, np.int32)
        self.holders[at] = holders[which]
        self.holders = self.holders.reshape(m, self.WIDE)
        self.tokens = np.zeros(bucket[-1] + 1, np.int64)
        np.maximum.at(self.tokens, base, number + 1)
        self.bucket = bucket
        self.first = np.full((m, self.WIDE), A.LAST, np.int64)
        self.column = np.arange(self.WIDE, dtype=np.int16)
        self.once = (self.prev < 0).all(axis=1)
        #: Tokens that two passages share if they are of the least length and just alike.
        self.least_shared = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))

    def _sums(self, flag: np.ndarray, least: float) -> np.ndarray:
        """Running sums of flags less `least`: a passage's share of flagged tokens is `least` where the sums at its ends are equal."""
        total = np.zeros((len(flag), self.WIDE + 1), np.float32)
        np.cumsum(flag - np.float32(least), axis=1, out=total[:, 1:])
        return total

    def feasible(self, flag: np.ndarray) -> np.ndarray:
        """Which columns, up to the anchor's, start a passage around it with a share of at least `similarity` of flagged tokens."""
        total = np.zeros((len(flag), self.WIDE + 1), np.float32)
        np.cumsum(flag - np.float32(self.similarity), axis=1, out=total[:, 1:])
        best = np.maximum.accumulate(total[:, ::-1], axis=1)[:, ::-1]
        return best[:, np.maximum(REACH, np.arange(REACH + 1) + self.width - 1) + 1] - total[:, : REACH + 1] > -0.01

    def reach(self, flag: np.ndarray) -> np.ndarray:
        """The flagged tokens that are in such a passage."""
        start, end = self.feasible(flag), self.feasible(flag[:, ::-1])  # passages' ends are starts from the other side
        low, high = start.argmax(axis=1), self.WIDE - 1 - end.argmax(axis=1)
        return flag & (self.column >= low[:, None]) & (self.column <= high[:, None]) & start.any(axis=1)[:, None]

    def cover(self, node: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray) -> None:
        """Columns start to end of each node have a near duplicate in the document `least`."""
        size = end - start + 1
        np.minimum.at(self.first.ravel(), ragged(node * self.WIDE + start, size), np.repeat(least, size))

    def open(self, node: np.ndarray, least: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Whether nodes hold tokens (those `among`) that may be alike elsewhere and aren't yet known from a document up to `least`."""
        return ((self.need[node] if among is None else among) & (self.first[node] > least[:, None])).any(axis=1)

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of nodes of one bucket each, by bucket, y of smaller doc_id: cover what is alike on both sides."""
        room = self.tokens[self.bucket[x]] + 1
        for i in range(0, len(x), 1000):
            self._compare(x[i : i + 1000], y[i : i + 1000], int(room[i : i + 1000].max()))

    def _flags(self, x: np.ndarray, y: np.ndarray, room: int, within: np.ndarray | None = None) -> np.ndarray:
        """Which tokens of x the node y has, or has among its tokens `within`."""
        most = max(1, TABLE // room)
        if len(x) > most:
            return np.concatenate([self._flags(x[i : i + most], y[i : i + most], room, None if within is None else within[i : i + most]) for i in range(0, len(x), most)])
        line = np.arange(len(x))[:, None]
        there = np.zeros((len(x), room), bool)
        there[line, self.id[y] if within is None else np.where(within, self.id[y], -1)] = True
        there[:, -1] = False  # where -1 goes
        return there[line, self.id[x]]

    def _still(self, x, y, a, b) -> np.ndarray:
        """Pairs that could cover something new on one side."""
        return np.flatnonzero(self.open(x, self.least[y], self.reach(a)) | self.open(y, np.full(len(y), A.LAST - 1), self.reach(b)))

    def _shared(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_flags of x and y and of y and x. A table of the bucket's tokens is made for each distinct node of the side that has fewer, not for each pair."""
        turned = len(np.unique(x)) > len(np.unique(y))
        one, other = (y, x) if turned else (x, y)
        nodes, which = np.unique(one, return_inverse=True)
        theirs, line, most = [], np.arange(len(one)), max(1, TABLE // (int(self.tokens[self.bucket[nodes]].max()) + 1))
        own = np.empty((len(nodes), self.WIDE), np.int16)
        for i in range(0, len(nodes), most):
            ids = self.id[nodes[i : i + most]]
            place = np.full((len(ids), int(self.tokens[self.bucket[nodes[i : i + most]]].max()) + 1), -1, np.int16)
            row = np.arange(len(ids))[:, None]
            place[row, ids] = self.column
            place[:, -1] = -1  # where -1 goes
            own[i : i + most] = place[row, ids]
            pairs = np.flatnonzero((which >= i) & (which < i + most))
            found = self.id[other[pairs]]
            theirs.append((pairs, place[which[pairs, None] - i, found]))
        at = np.empty((len(one), self.WIDE), np.int16)
        for pairs, found in theirs:
            at[pairs] = found
        there = np.zeros((len(one), self.WIDE + 1), bool)
        there[line[:, None], at] = True
        there[:, -1] = False
        flags = there[line[:, None], own[which]], at >= 0
        return flags[::-1] if turned else flags

    def _compare(self, x: np.ndarray, y: np.ndarray, room: int) -> None:
        a, b = self._shared(x, y)
        on = np.flatnonzero((a.sum(axis=1) >= self.least_shared) & (b.sum(axis=1) >= self.least_shared))
        x, y, a, b = x[on], y[on], a[on], b[on]
        on = np.flatnonzero(self.feasible(a).any(axis=1))
        x, y, a, b = x[on], y[on], a[on], b[on]
        # where y repeats a token, its places say nothing about its set
        feasible = ~self.once[y]
        once = np.flatnonzero(self.once[y])
        feasible[once] = self.feasible(b[once]).any(axis=1)
        x, y, a, b = x[feasible], y[feasible], a[feasible], b[feasible]
        on = self._still(x, y, a, b)
        x, y, a, b = x[on], y[on], a[on], b[on]
        if not len(x):
            return
        # tokens that stand once in both and in the same order
        ordered = self.once[x] & self.once[y]
        plain = np.flatnonzero(ordered)
        if len(plain):
            p, q = a[plain], b[plain]
            differ = self.id[x[plain]][p] != self.id[y[plain]][q]  # as many on both sides
            ordered[plain] = np.bincount(np.nonzero(p)[0], differ, len(plain)) == 0
        on = np.flatnonzero(ordered)
        if len(on):
            self._ordered(x[on], y[on], a[on], b[on])
        on = np.flatnonzero(~ordered)
        x, y, a, b = x[on], y[on], a[on], b[on]
        # as a whole first, then the densest part around each anchor
        for least in (None, self.similarity, 2 * self.similarity / (1 + self.similarity)):
            if not len(x):
                return
            p, q = (self._part(z, flag, least) for z, flag in ((x, a), (y, b)))
            both = (self._flags(x, y, room, q[2]) & p[2] & (self.prev[x] < p[0][:, None])).sum(axis=1)
            alike = both >= self.similarity * (p[3] + q[3] - both) - 1e-9
            for flag, part in ((a, p), (b, q)):
                alike &= (flag & part[2]).sum(axis=1) >= self.least_shared
            self.cover(x[alike], p[0][alike], p[1][alike], self.least[y[alike]])
            self.cover(y[alike], q[0][alike], q[1][alike], self.least[x[alike]])
            on = self._still(x, y, a, b)
            x, y, a, b = x[on], y[on], a[on], b[on]
        for i in range(0, len(x), 50):
            part = slice(i, i + 50)
            self._parts(x[part], y[part], a[part], b[part])
            self._parts(y[part], x[part], b[part], a[part])

    def _ordered(self, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs whose shared tokens stand once and in the same order: all passages from one shared token to another, exactly.

        With m shared tokens from p to q in x and from r to s in y, they are alike if m >= similarity * (q - p + 1 + s - r + 1 - m): a
        difference of two values, one of each end. All of them hold the anchor, so what they cover together is one range.
        """
        line, at = np.nonzero(a)
        there = np.nonzero(b)[1]
        many = a.sum(axis=1)
        rank = np.arange(len(line)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
        size = int(many.max())
        value = np.full((len(x), size), -1e6, np.float32)
        s = self.similarity
        value[line, rank] = (1 + s) * rank - s * (at + there)
        anchor = a[:, :REACH].sum(axis=1)  # its rank
        number = np.arange(size)
        own = 1 + s - 2 * s + 1e-3  # of a passage of one token
        best = np.maximum.accumulate(value[:, ::-1], axis=1)[:, ::-1]  # the best end from here
        to = np.maximum(anchor[:, None], number + self.least_shared - 1)
        starts = (number <= anchor[:, None]) & (to < size) & (np.take_along_axis(best, np.minimum(to, size - 1), 1) - value + own >= 0)
        lowest = np.minimum.accumulate(np.where(value == -1e6, 1e6, value), axis=1)  # the best start up to here
        from_ = np.minimum(anchor[:, None], number - self.least_shared + 1)
        ends = (number >= anchor[:, None]) & (number < many[:, None]) & (from_ >= 0) & (value - np.take_along_axis(lowest, np.maximum(from_, 0), 1) + own >= 0)
        on = np.flatnonzero(starts.any(axis=1) & ends.any(axis=1))
        if not len(on):
            return
        base = np.r_[0, np.cumsum(many)[:-1]][on]
        low, high = base + starts[on].argmax(axis=1), base + size - 1 - ends[on][:, ::-1].argmax(axis=1)
        self.cover(x[on], at[low], at[high], self.least[y[on]])
        self.cover(y[on], there[low], there[high], self.least[x[on]])

    def _part(self, x: np.ndarray, flag: np.ndarray, least: float | None) -> tuple[np.ndarray, ...]:
        """(first, last, inside, many): a passage from one flagged token to another, its columns, and how many distinct tokens it has.
        With `least` it is the one around the anchor that has most over that share."""
        if least is not None:
            total = np.zeros((len(flag), self.WIDE + 1), np.float32)
            np.cumsum(flag - np.float32(least), axis=1, out=total[:, 1:])
            i, j = total[:, : REACH + 1].argmin(axis=1), REACH + total[:, REACH + 1 :].argmax(axis=1)
            flag = flag & (self.column >= i[:, None]) & (self.column <= j[:, None])
        i, j = flag.argmax(axis=1), self.WIDE - 1 - flag[:, ::-1].argmax(axis=1)
        inside = self.there[x] & (self.column >= i[:, None]) & (self.column <= j[:, None])
        return i, j, inside, (inside & (self.prev[x] < i[:, None])).sum(axis=1)

    def _parts(self, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs that aren't alike so far: passages of x from the start of a run of shared tokens to the end of one, and for each the passage of y that
        has its shared tokens where they are nearest to the anchor.

        A row for each start and a column for each end. All that a pair's passages cover together is one range, as each holds the anchor.
        """
        column, s = self.column, self.similarity
        line, at = np.nonzero(b)
        room = int(self.id[y].max()) + 1
        key = line * room + self.id[y[line], at]
        order = np.lexsort((at, np.abs(at - REACH), key))
        key, one = np.unique(key[order], return_index=True)
        line, own = np.nonzero(a)
        place = np.full(a.shape, -1, np.int16)
        place[line, own] = at[order[one]][np.searchsorted(key, line * room + self.id[x[line], own])]
        before, after = np.zeros(a.shape, bool), np.zeros(a.shape, bool)
        before[:, 1:], after[:, :-1] = a[:, :-1], a[:, 1:]
        line, start = np.nonzero((a & ~before)[:, : REACH + 1])
        end = a & ~after & (column >= REACH)
        inside = column >= start[:, None]
        shared = a[line] & inside
        new = inside & (self.prev[x[line]] < start[:, None])
        own, both, count = (np.cumsum(z, axis=1, dtype=np.int16) for z in (new, new & shared, shared))
        low = np.minimum.accumulate(np.where(shared, place[line], np.int16(self.WIDE)), axis=1)
        high = np.maximum.accumulate(np.where(shared, place[line], np.int16(-1)), axis=1)
        row, last = np.nonzero(end[line] & (count >= s * (column + 1 - start[:, None]) - 0.01) & (count >= self.least_shared) & (both >= s * own - 1e-9))
        if not len(row):
            return
        own, both, k, l, line, start = own[row, last], both[row, last], low[row, last].astype(np.int64), high[row, last], line[row], start[row]
        begins, which = np.unique(line * self.WIDE + k, return_inverse=True)
        begin = (begins % self.WIDE)[:, None]
        rest = np.cumsum((column >= begin) & (self.prev[y[begins // self.WIDE]] < begin), axis=1, dtype=np.int16)[which, l]
        total = np.zeros((len(y), self.WIDE + 1), np.int16)
        np.cumsum(b, axis=1, out=total[:, 1:])
        alike = np.flatnonzero((both >= s * (own + rest - both) - 1e-9) & (total[line, l + 1] - total[line, k] >= self.least_shared))
        if len(alike):
            line, start, last, k, l = line[alike], start[alike], last[alike], k[alike], l[alike]
            new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            pair = line[new]
            self.cover(x[pair], np.minimum.reduceat(start, new), np.maximum.reduceat(last, new), self.least[y[pair]])
            self.cover(y[pair], np.minimum.reduceat(k, new), np.maximum.reduceat(l, new), self.least[x[pair]])

    def run(self) -> tuple[np.ndarray, ...]:
        """(node, start, end, first) of all intervals, in tokens from the anchor."""
        several = np.flatnonzero(self.n > 1)
        self.first[several] = np.where(self.there[several], self.least[several, None], A.LAST)
        self.need = self.reach(self.id >= 0)
        hopeful = np.flatnonzero(self.need.any(axis=1))
        hopeful = hopeful[self._outlines(hopeful)]
        # nodes meet in order of their smallest doc_id, for as long as one of the two has something open
        hopeful = hopeful[np.lexsort((self.least[hopeful], self.bucket[hopeful]))]
        bucket = self.bucket[hopeful]
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
        many = np.diff(np.r_[begin, len(bucket)])
        for s, k in zip(begin[many > LISTED].tolist(), many[many > LISTED].tolist()):
            self._large(hopeful[s : s + k])
        begin, many = begin[many <= LISTED], many[many <= LISTED]
        turn = 0
        while True:
            more = many > turn + 1
            begin, many = begin[more], many[more]
            if not len(many):
                break
            y = np.repeat(hopeful[begin + turn], many - turn - 1)
            self._meet(hopeful[ragged(begin + turn + 1, many - turn - 1)], y)
            turn += 1
        flat = self.first.ravel()
        change = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (np.arange(1, len(flat)) % self.WIDE == 0)])
        end = np.r_[change[1:], len(flat)] - 1
        on = flat[change] < A.LAST
        change, end = change[on], end[on]
        return change // self.WIDE, change % self.WIDE - REACH, end % self.WIDE - REACH, flat[change]

    def _outlines(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes that differ in how often a token is repeated at once are alike; one of each kind, of the smallest doc_id, meets the rest."""
        order = np.lexsort((self.least[nodes], self.outline[nodes], self.bucket[nodes]))
        x = nodes[order]
        new = np.r_[True, (self.outline[x[1:]] != self.outline[x[:-1]]) | (self.bucket[x[1:]] != self.bucket[x[:-1]])][: len(x)]
        start = np.flatnonzero(new)
        many = np.diff(np.r_[start, len(x)])
        others = np.flatnonzero(~new)
        least = self.least[x[start]]
        for on, doc in ((others, np.repeat(least, many)[others]), (start[many > 1], self.least[x[start[many > 1] + 1]])):
            self.first[x[on]] = np.where(self.there[x[on]], np.minimum(self.first[x[on]], doc[:, None]), A.LAST)
        return np.sort(order[new])

    def _meet(self, x: np.ndarray, y: np.ndarray) -> None:
        """Nodes x with nodes y of smaller doc_id."""
        on = self.open(x, self.least[y]) | self.open(y, np.full(len(y), A.LAST - 1))
        self.compare(x[on], y[on])

    def _large(self, nodes: np.ndarray) -> None:
        """The same in a bucket of many: all meet the first few, which settles what many share; after that a node meets those that may be
        alike in a token of it that is still open (of smaller doc_id, once it has a partner at all)."""
        m = len(nodes)
        for k in range(LEADERS):
            x = nodes[k + 1 :]
            x = x[self.open(x, np.full(len(x), self.least[nodes[k]]))]
            self.compare(x, np.full(len(x), nodes[k]))
        holders = Holders(self.id[nodes])
        for i in range(0, m, LISTERS):
            lists = []
            for end in range(i, min(m, i + LISTERS)):
                found = self._partners(nodes, end, holders)
                if found:
                    lists.append((end, found))
            many = FIRST
            while lists:
                # what the first of a list have covered, the others needn't
                rest, pairs = [], []
                for end, (other, low, high) in lists:
                    alone, later = (np.r_[0, np.cumsum(x)] for x in self._wanted(nodes[end]))
                    on = (alone[high + 1] > alone[low]) | (other < end) & (later[high + 1] > later[low])
                    other, low, high = other[on], low[on], high[on]
                    pairs.append(np.minimum(other[:many], end) * m + np.maximum(other[:many], end))
                    if len(other) > many:
                        rest.append((end, (other[many:], low[many:], high[many:])))
                pairs = np.unique(np.concatenate(pairs))
                self.compare(nodes[pairs % m], nodes[pairs // m])
                lists, many = rest, 2 * many

    def _wanted(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a node that no partner is known for, and those that one of smaller doc_id isn't known for."""
        first, need = self.first[x], self.need[x]
        return need & (first == A.LAST), need & (first >= self.least[x]) & (first < A.LAST)

    def _partners(self, nodes: np.ndarray, end: int, holders: Holders) -> tuple[np.ndarray, ...] | None:
        """(other, low, high): which of `nodes` may be alike to the one at `end` in tokens that it wants, within which columns of it.

        All others are told at once, column by column, from what holds of any two that are alike: they share enough of the columns around the anchor
        and, where shared tokens stand once and in the same order in both, enough of both passages (as `_ordered` has it).
        """
        x = nodes[end]
        alone, later = self._wanted(x)
        columns = np.flatnonzero(self.id[x] >= 0)
        if len(columns) < self.least_shared or not (alone.any() or later.any()):
            return None
        ids, s = self.id[x, columns], np.float32(self.similarity)
        first = LEADERS if end >= LEADERS else 0  # the first ones have been met by the others only
        found = []
        for lo, last, wanted in ((first, end, alone | later), (end + 1, len(nodes), alone)):
            for lo in range(lo, last if wanted.any() else 0, OTHERS):
                other = np.arange(lo, min(last, lo + OTHERS))
                at = holders.places(ids, lo, lo + len(other))
                on = np.flatnonzero(((at > 0).sum(axis=0, dtype=np.int16) >= self.least_shared) & (at[wanted[columns]] > 0).any(axis=0))
                other, at = other[on], at[:, on]
                ordered = np.zeros(len(other), bool)
                if self.once[x]:
                    ordered = self.once[nodes[other]] & ~((at[1:] > 0) & (at[1:] < running(np.maximum, at)[:-1])).any(axis=0)
                for kind in (ordered, ~ordered):
                    on = np.flatnonzero(kind)
                    if not len(on):
                        continue
                    places = at if len(on) == len(kind) else at[:, on]
                    flag = places > 0
                    rank = running(np.add, flag.astype(np.float32))
                    if kind is ordered:
                        value = (1 + s) * rank - s * places - s * columns[:, None].astype(np.float32)
                        away = (places == 0) * np.float32(1e6)
                        low, high = self._around(columns, flag, value + away, value - away + (1 - s), self.least_shared - 1, wanted)
                    else:
                        value = rank - s * (columns[:, None] + 1).astype(np.float32)
                        low, high = self._around(columns, flag, value - (1 - s), value, self.width * self.similarity - 1, wanted)
                    hit = np.flatnonzero(low <= high)
                    found.append((other[on[hit]], low[hit], high[hit]))
        if not found:
            return None
        other, low, high = map(np.concatenate, zip(*found))
        order = np.argsort(other)
        return other[order], low[order], high[order]

    def _around(self, columns: np.ndarray, flag: np.ndarray, starts: np.ndarray, ends: np.ndarray, spread: float, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """(low, high) for each of the others: the outermost of the wanted columns, or the anchor's, that a passage may cover; low > high where none.

        A passage may go from one column to another, at least `spread` behind, where its end's value isn't below its start's. Rows of `flag`, `starts`
        and `ends` are those of `columns`.
        """
        sides = []
        for turned in (False, True):
            if turned:
                columns, flag, starts, ends, wanted = self.WIDE - 1 - columns[::-1], flag[::-1], -ends[::-1], -starts[::-1], wanted[::-1]
            out = np.full(flag.shape[1], self.WIDE)
            asked = np.flatnonzero(wanted[columns] & (columns <= REACH))
            if len(asked):
                to = np.searchsorted(columns, np.maximum(REACH, columns[: asked[-1] + 1] + spread - 1e-6))
                to = to[to < len(columns)]
                if len(to):
                    best = running(np.maximum, ends[to[0] :][::-1])[::-1]
                    may = running(np.logical_or, best[to - to[0]] - starts[: len(to)] >= -0.01)
                    hit = may[np.minimum(asked, len(to) - 1)] & flag[asked]
                    out -= (hit * (self.WIDE - columns[asked]).astype(np.uint8)[:, None]).max(axis=0)
            sides.append(out)
        left, right = sides
        none = (left == self.WIDE) & (right == self.WIDE)
        return np.where(none, REACH + 1, np.minimum(left, REACH)), np.where(none, REACH, self.WIDE - 1 - np.minimum(right, REACH))


def compared_batches(table: pa.Table, width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """INTERVALS of a table of SEGMENTS that has whole buckets, sorted by h."""
    table = table.combine_chunks()
    data = {c: table[c].chunk(0) for c in table.column_names}
    h, left, n, least = (data[c].to_numpy() for c in ("h", "left", "n", "least"))
    size = np.diff(np.frombuffer(data["segment"].buffers()[1], np.int32)[data["segment"].offset :][: len(h) + 1]) // 2
    words = np.frombuffer(b"".join(data["segment"].to_pylist()), "<u2")
    # rows of equal contexts, from different tasks, are one node
    same = segments_of(words, size)
    order = np.lexsort((same, left, h))
    new = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (left[order[1:]] != left[order[:-1]]) | (same[order[1:]] != same[order[:-1]])]
    start = np.flatnonzero(new)
    node = np.empty(len(h), np.int64)
    node[order] = np.cumsum(new) - 1
    one = order[start]
    n, least = np.add.reduceat(n[order], start), np.minimum.reduceat(least[order], start)
    group, left, size_ = h[one], left[one].astype(np.int64), size[one]
    lonely = np.r_[True, group[1:] != group[:-1]] & np.r_[group[1:] != group[:-1], True]
    # a context that others have as a whole needs no comparison where it is alone in its bucket
    whole = np.flatnonzero(lonely & (n > 1))
    which, s, e, first = [whole], [-left[whole]], [size_[whole] - SHINGLE - left[whole]], [least[whole]]
    rest = np.flatnonzero(~lonely)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    i = 0
    while i < len(rest):  # some hundred nodes at a time, whole buckets
        j = min(len(rest), i + 3000)
        while j < len(rest) and group[rest[j]] == group[rest[j - 1]]:
            j += 1
        part = rest[i:j]
        at = one[part]
        b = Bucket(group[part], left[part], size_[part], words[ragged(begin[at], size[at])], n[part], least[part], width, similarity)
        x, y, z, f = b.run()
        which.append(part[x])
        s.append(y)
        e.append(z)
        first.append(f)
        i = j
    which, s, e, first = (np.concatenate(x) for x in (which, s, e, first))
    # every place of every row of a node has the node's intervals
    by_node = np.argsort(which, kind="stable")
    which, s, e, first = which[by_node], s[by_node], e[by_node], first[by_node]
    lo, hi = np.searchsorted(which, node), np.searchsorted(which, node, side="right")
    docs, at = data["docs"], data["at"]
    entries = np.diff(docs.offsets.to_numpy())
    owner = np.repeat(np.arange(len(node)), entries)
    docs, at = docs.flatten().to_numpy(), at.flatten().to_numpy()
    many = (hi - lo)[owner]
    for i in range(0, len(owner), 20_000):
        o, k = owner[i : i + 20_000], many[i : i + 20_000]
        x = ragged(lo[o], k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs[i : i + 20_000], k)), pa.array((np.repeat(at[i : i + 20_000], k) + s[x]).astype(np.int32)), pa.array((np.repeat(at[i : i + 20_000], k) + e[x] + SHINGLE).astype(np.int32)), pa.array(first[x])], schema=A.INTERVALS)


def compared(found: DataFrame, width: int, similarity: float) -> DataFrame:
    """(row, start, end, first): the repeated intervals in words, and the smallest doc_id that each was found in."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > COMPARED:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                last = int(np.searchsorted(h, h[-1]))
                if last:
                    yield from compared_batches(table.slice(0, last), width, similarity)
                    held = pa.Table.from_batches(table.slice(last).to_batches()).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                yield from compared_batches(table, width, similarity)

    sent = found.select("h", "left", "segment", "n", "least", "docs", "at").repartition(partitions(found.sparkSession), "h").sortWithinPartitions("h")
    return sent.mapInArrow(tidy(run), "row long, start int, end int, first long")


# --- the operator ---------------------------------------------------------------------------------------------------

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PASSAGES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("later", SPANS), ("class_id", pa.int64()), ("kept", pa.string())])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, start: np.ndarray, end: np.ndarray) -> str:
    """The text without these words and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    begins = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, last = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        out.append(data[last : begins[s]])
        last = begins[min(e, len(begins) - 1)]
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _intervals(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    width = words - SHINGLE + 1
    return compared(segments(docs, repeated_windows(docs, width), width), width, similarity)


def _read(span, own: int) -> tuple[np.ndarray, ...]:
    """(start, end) of a row's intervals, (start, end) of those that a smaller doc_id has, and the smallest doc_id of all."""
    none = np.empty(0, np.int64)
    if not span.is_valid or not len(span.values):
        return none, none, none, none, own
    both, first = (span.values.field(k).to_numpy() for k in (0, 1))
    before = both[first < own]
    return *merged(both >> 32, both & 0xFFFFFFFF), *merged(before >> 32, before & 0xFFFFFFFF), min(own, int(first.min()))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs`, all columns, without the passages that a document of smaller doc_id has; texts that nothing is left of go with their row."""
    ours = A.rows_of(carried(docs))

    def strip(batches):
        for b in batches:
            ids, texts, spans = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text", "spans"))
            change, keep = [], np.ones(len(ids), bool)
            for i, (doc, span) in enumerate(zip(ids.to_pylist(), spans)):
                *_, start, end, _ = _read(span, A.LAST if doc is None else doc)
                if len(start):
                    kept = without(texts[i].as_py(), start, end)
                    keep[i] = bool(kept.strip())
                    change.append((i, kept))
            if change:
                where, new = zip(*change)
                mask = np.zeros(len(ids), bool)
                mask[list(where)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            b = b.set_column(b.schema.get_field_index("text"), "text", texts).drop_columns(["row", "spans"])
            yield b.filter(pa.array(keep))

    found = A.with_spans(ours, _intervals(ours, words, similarity), first=True).select(*ours.columns, "spans")
    return restored(found.mapInArrow(tidy(strip), ours.drop("row").schema), docs)


def passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_words, spans, later, class_id, kept) of every row.

    `spans`: the words (start, end) in passages with a near duplicate in another document; `later`: those of them that
    have one in a document of smaller doc_id; `class_id`: the smallest doc_id that the row shares a passage with, its own
    if none; `kept`: the text without what is in `later`.
    """
    docs = A.rows_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = _intervals(docs, words, similarity)

    def finish(batches):
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text or ""
                start, end, later_start, later_end, least = _read(spans, A.LAST if doc is None else doc)
                kept = without(text, later_start, later_end) if len(later_start) else text
                as_structs = lambda s, e: [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
                out.append((doc, len(text.encode("utf-8", "surrogatepass").split()), as_structs(start, end), as_structs(later_start, later_end), doc if least == A.LAST else least, kept))
            columns = list(zip(*out)) or [[]] * len(PASSAGES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PASSAGES)], schema=PASSAGES)

    spans = "array<struct<start:bigint,end:bigint>>"
    return A.with_spans(docs, found, first=True).select("doc_id", "text", "spans").mapInArrow(tidy(finish), f"doc_id long, n_words long, spans {spans}, later {spans}, class_id long, kept string")
