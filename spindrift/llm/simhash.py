"""SimHash near-dedup: fingerprints that differ in few bits are found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, read as words of the perfect binary Golay code
[23, 12, 7] (every word lies within distance 3 of exactly one codeword). The index of the codeword nearest to a segment
and the indices nearest to its one-bit neighbours are the segment's fuzzy keys: one for words within distance 2 of a
codeword, several for the others. If two segments differ in one bit, the nearest codeword of either is a fuzzy key of
the other.

Up to three errors fall on the segments in one of these ways (pigeonhole), and each has its keys:

- one segment has them all: the other two are equal, key (i, j) exact;
- one segment is equal, another has one error: key (i exact, j fuzzy);
- each segment has one error: key (all three fuzzy).

One error changes a segment's parity, so of two such segments one is even and one odd: only the even one has to list its
several fuzzy keys, the odd one gives its nearest codeword. Keys have 33 to 42 bits, so chance meetings stay few as the
number of fingerprints grows. Fingerprints that share a key are compared, and within a bucket only the links of a
spanning forest leave the task: every pair within the distance is connected, but not every pair is written.

Cases: equal fingerprints are one node whatever the number of documents; a text without words has fingerprint zero and
is linked like any other; null is the empty text; an empty table gives an empty result; rows with equal doc_id share
their links; columns beyond `doc_id` and `text` are ignored by `fingerprints` and `classes`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialise, partitions, restored, texts, tidy
from .components import components, forest

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Shifts and widths of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The Golay code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011

# --- fingerprints ---------------------------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space; other characters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str) -> int:
    """64 bits: bit i is 1 if it is set in more than half of the shingles' hashes."""
    from xxhash import xxh64_intdigest as xxh

    words = words_of(text)
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxh(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[: n - SHINGLE]].tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), 4096):
        h = np.array([xxh(line[s:e], SEED) for s, e in zip(starts[i : i + 4096], ends[i : i + 4096])], "<u8")
        total += _bit_sums(h)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def read(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], schema=PRINTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(read), "doc_id long, fp long")


# --- Golay keys -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the bytes of a word (three tables of 256), and the error of each of the 2048 remainders."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    tables = np.array([[remainder(byte << shift) if byte << shift < 1 << 23 else 0 for byte in range(256)] for shift in (0, 8, 16)], np.int64)
    errors = np.zeros(2048, np.int64)
    single = [1 << i for i in range(23)]
    for x in single:
        errors[remainder(x)] = x
        for y in single:
            if y > x:
                errors[remainder(x | y)] = x | y
                for z in single:
                    if z > y:
                        errors[remainder(x | y | z)] = x | y | z
    return tables, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    tables, errors = _golay()
    remainder = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16]
    return (words ^ errors[remainder]) >> 11


def _segment(fp: np.ndarray, s: int) -> np.ndarray:
    shift, width = SEGMENTS[s]
    return (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)


def _one_sided(fp: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fuzzy key): all keys of an even segment, the nearest codeword of an odd one."""
    word, width = _segment(fp, s), SEGMENTS[s][1]
    even = (np.bitwise_count(word) & 1) == 0
    rows = np.flatnonzero(even)
    around = np.concatenate([word[rows][:, None], word[rows][:, None] ^ (1 << np.arange(width))[None, :]], axis=1)
    keys = np.sort(nearest(around), axis=1)
    new = np.concatenate([np.ones((len(rows), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    odd = np.flatnonzero(~even)
    return np.r_[np.repeat(rows, new.sum(axis=1)), odd], np.r_[keys[new], nearest(word[odd])]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that rows within DISTANCE bits share a key."""
    part = [_segment(fp, s) for s in range(3)]
    fuzzy = [_one_sided(fp, s) for s in range(3)]
    rows, keys = [], []

    def add(row, key, kind):
        rows.append(row)
        keys.append(key | np.int64(kind) << 58)

    everyone = np.arange(len(fp))
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        add(everyone, part[i] << 22 | part[j], kind)
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 3):
        row, key = fuzzy[j]
        add(row, part[i][row] << 12 | key, kind)
    # all three fuzzy: the parities of partners are opposite in every segment
    parity = [np.bitwise_count(p) & 1 for p in part]
    sides = np.minimum(code := parity[0] * 4 + parity[1] * 2 + parity[2], 7 - code).astype(np.int64)
    row, key = fuzzy[0]
    key = sides[row] << 12 | key
    for s in (1, 2):
        order = np.argsort(fuzzy[s][0], kind="stable")
        other, theirs = fuzzy[s][0][order], fuzzy[s][1][order]
        first, many = np.searchsorted(other, row), np.searchsorted(other, row, side="right")
        many -= first
        at = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        row, key = np.repeat(row, many), np.repeat(key, many) << 12 | theirs[at]
    add(row, key, 9)
    return np.concatenate(rows), np.concatenate(keys)


KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def _emit_keys(batches):
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fp), 4096):
            part = fp[i : i + 4096]
            row, key = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], schema=KEYS)


# --- links ----------------------------------------------------------------------------------------------------------

#: Buckets above this are split by pieces of their bits first.
BUCKET = 2048
#: Pairs that are compared at once, and links that are held before they shrink to a forest.
PAIRS = 200_000
#: Fingerprints with more than this share of all documents, so fewer than so many, are joined by broadcast.
HOT_SHARE = 1000


def near(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints.

    The bits that vary within a bucket are cut into distance + 1 pieces: at so many errors one of them is equal. Those
    that agree in a piece may differ anywhere else, so each such group is cut anew, by the bits that vary in it.
    """
    if len(fp) < 2:
        return fp[:0], fp[:0]
    a, b = [], []
    groups = _split(fp, distance) if len(fp) > BUCKET else None
    if groups is None:
        step = max(1, PAIRS // len(fp))
        for i in range(0, len(fp), step):
            x, y = np.nonzero(np.bitwise_count(fp[i : i + step, None] ^ fp[None, i + 1 :]) <= distance)
            keep = x <= y
            a.append(fp[x[keep] + i])
            b.append(fp[y[keep] + i + 1])
            if sum(map(len, a)) > PAIRS:
                a, b = ([z] for z in forest(np.concatenate(a), np.concatenate(b)))
    else:
        for group in groups:
            x, y = near(fp[group], distance)
            a.append(x)
            b.append(y)
    if not a:
        return fp[:0], fp[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def _split(fp: np.ndarray, distance: int) -> list[np.ndarray] | None:
    """The groups that agree in one of distance + 1 pieces of the varying bits; None if all pairs are no more work than theirs."""
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [i for i in range(64) if varying >> i & 1]
    groups = []
    for piece in np.array_split(bits, distance + 1):
        value = fp & np.uint64(sum(1 << int(i) for i in piece))
        order = np.argsort(value, kind="stable")
        groups += [g for g in np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(g) > 1]
    return groups if 2 * sum(len(g) ** 2 for g in groups) < len(fp) ** 2 else None


def _link(batches):
    """Batches sorted by key: the links within each bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def links(key, fp):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[start, len(key)])
        pairs = start[many == 2]
        close = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= DISTANCE
        a, b = [fp[pairs[close]]], [fp[pairs[close] + 1]]
        for s, n in zip(start[many > 2], many[many > 2]):
            x, y = near(np.unique(fp[s : s + n]))
            a.append(x)
            b.append(y)
        a, b = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        many += batch.num_rows
        if many > 200_000:
            key, fp = map(np.concatenate, zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from links(key[:cut], fp[:cut])
            held, many = [(key[cut:].copy(), fp[cut:].copy())], len(key) - cut
    if many:
        yield from links(*map(np.concatenate, zip(*held)))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by chains of fingerprints within DISTANCE bits share a component."""
    spark = docs.sparkSession
    prints = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    keyed = nodes.select("fp").repartition(partitions(spark)).mapInArrow(tidy(_emit_keys), "key long, fp long")
    links = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(tidy(_link), "a long, b long")
    found = components(links)
    least = found.join(nodes, found.node == nodes.fp).groupBy("component").agg(F.min("rep").alias("component_id"))
    named = found.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    reps = materialise(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id")), "classes")
    # a fingerprint that holds more than a thousandth of all documents is one of fewer than a thousand: those are broadcast, so
    # that no task gets all documents of one
    hot = reps.where(F.col("n") * HOT_SHARE > prints.count()).select("fp", "component_id")
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(reps.select("fp", "component_id"), "fp")
    return prints.join(F.broadcast(hot), "fp").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents with one of each component left: the one of the smallest doc_id, those without doc_id last.

    Of rows that are equal in doc_id and text one stays.
    """
    keyed = carried(docs).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(2**62)))
    found = classes(keyed.select(F.col("key").alias("doc_id"), "text"))
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    # only the ids are looked at by both sides; of the few rows that share one, those of equal text are one
    first = F.row_number().over(Window.partitionBy("key", F.xxhash64("text")).orderBy("key"))
    return restored(keyed.join(keep, "key", "left_semi").withColumn("n", first).where("n = 1"), docs)
