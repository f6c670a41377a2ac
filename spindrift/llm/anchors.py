"""Passages that occur in several places, found through anchors: what op3 and op9 share.

An anchor is a place that a text's own content selects (the minimum of hashes in a window), so that equal passages have
equal anchors wherever they stand. Only anchors whose hash occurs at least twice in the whole corpus can belong to a
repeated passage; for those alone the text around the anchor is sent to where its equals are.

1. every document gives its anchors' hashes, collected by hash within each task before they are dealt out;
2. hashes that occur once fall away; the others return to their documents as one list each;
3. those documents give one segment per anchor (the text around it), equal ones collected within each task;
4. segments meet by hash and are compared there (`compare`), which gives intervals of the documents;
5. a document's intervals meet its text.

A hash that a third of all documents share arrives as one row per task and distinct segment, not one per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

COUNTS = pa.schema([("h", pa.int64()), ("docs", pa.list_(pa.int64()))])
SEGMENTS = pa.schema([("h", pa.int64()), ("left", pa.int32()), ("segment", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("docs", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
INTERVALS = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.int64())])
#: Stands for a null doc_id where ids are ordered.
LAST = 2**63 - 1


def rows_of(docs: DataFrame) -> DataFrame:
    """`docs` with a column `row` that tells rows apart: a hash of doc_id and text, as doc_id may be null or repeat.

    Rows that are equal in both share it, and with it their places and their result.
    """
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def by_hash(h: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per hash: the rows it is in."""
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(h)) + 1, len(h)]
    for i in range(0, len(cuts) - 1, 50_000):
        c = cuts[i : i + 50_001]
        lo, hi = c[0], c[-1]
        lists = pa.ListArray.from_arrays(pa.array((c - lo).astype(np.int32)), pa.array(rows[lo:hi]))
        yield pa.RecordBatch.from_arrays([pa.array(h[c[:-1]]), lists], schema=COUNTS)


#: Anchors that a task holds before it writes them out.
HELD = 400_000


def repeated_anchors(docs: DataFrame, anchors: Callable, hot: int) -> DataFrame:
    """(row, hs, hot): a row's anchor hashes that occur at least twice in the corpus, as one list, apart for those in more than `hot` places.

    `anchors(text)` gives the hashes of a text, each as often as it is there.
    """

    def emit(batches):
        h, d, held = [], [], 0
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = anchors(text or "")
                if not len(found):
                    continue
                values, many = np.unique(found, return_counts=True)
                values = np.r_[values, values[many > 1]].view(np.int64)  # twice in one row is repeated already
                h.append(values)
                d.append(np.full(len(values), row))
                held += len(values)
                if held > HELD:
                    yield from by_hash(np.concatenate(h), np.concatenate(d))
                    h, d, held = [], [], 0
        if held:
            yield from by_hash(np.concatenate(h), np.concatenate(d))

    return in_several(docs.select("row", "text").mapInArrow(emit, "h long, docs array<long>"), hot)


def in_several(found: DataFrame, hot: int | None = None) -> DataFrame:
    """(row, hs) of (h, docs): a row's hashes that occur at least twice; with `hot`, apart for those in more than `hot` places."""
    # both sides of the join read the same exchange: the filter that a join implies stands before it for both, and
    # explode_outer (no list is empty) implies none
    found = found.where("h is not null").repartition(partitions(found.sparkSession), "h")
    twice = found.groupBy("h").agg(F.sum(F.size("docs")).alias("places")).where("places >= 2")
    kind = [] if hot is None else [(F.col("places") > hot).alias("hot")]
    kept = found.join(twice.select("h", *kind).hint("shuffle_hash"), "h").select("h", *(["hot"] if kind else []), F.explode_outer("docs").alias("row"))
    return kept.groupBy("row", *(["hot"] if kind else [])).agg(F.collect_set("h").alias("hs"))


def segments(docs: DataFrame, repeated: DataFrame, cut: Callable) -> DataFrame:
    """(h, left, segment, n, least, docs, at): the text around each such anchor; `least` is the smallest doc_id that has it.

    `cut(text, hashes)` gives (h, left, segment, n, at, sure): a distinct segment of the text, how much of it stands left
    of the anchor, in how many places, the first of them, and the intervals known already to be repeated (for the others).
    Those intervals become rows with left = -1.
    """

    def emit(batches):
        held: dict = {}
        size = 0

        def out():
            rows = [(*key, *v) for key, v in held.items()]
            for i in range(0, len(rows), 10_000):
                columns = list(zip(*rows[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SEGMENTS)], schema=SEGMENTS)

        for b in batches:
            row, text, hs, doc = (b.column(b.schema.get_field_index(c)) for c in ("row", "text", "hs", "doc_id"))
            for row, text, hs, doc in zip(row.to_pylist(), text.to_pylist(), hs, doc.fill_null(LAST).to_pylist()):
                for h, left, seg, n, at, sure in cut(text or "", hs.values.to_numpy()):
                    key = (h, left, seg)
                    got = held.get(key)
                    if got is None:
                        held[key] = [n, doc, [row], [at]]
                        size += len(seg) + 400
                    else:
                        got[0] += n
                        got[1] = min(got[1], doc)
                        got[2].append(row)
                        got[3].append(at)
                        size += 80
                    if sure is not None:
                        held[(row, -1, sure)] = [1, doc, [row], [at]]
                        size += len(sure) + 400
                    if size > 60_000_000:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    # all columns come along, so that the exchange of the documents is the one that with_spans reads
    joined = docs.join(repeated.hint("shuffle_hash"), "row")
    return joined.select(*docs.columns, "hs").mapInArrow(emit, "h long, left int, segment binary, n long, least long, docs array<long>, at array<int>")


#: Rows that are compared at once; a group of equal hashes is never cut.
CHUNK = 20_000


def compared(found: DataFrame, compare: Callable) -> DataFrame:
    """(row, start, end, first): the repeated intervals, and the smallest doc_id that the comparison names for each.

    `compare(group, left, segments, n, least)` gives (index, start, end, first), places counted from the anchor.
    """

    def run(batches):
        held, size = [], 0

        def out(table):
            table = table.combine_chunks()
            left = table["left"].to_numpy()
            known = np.flatnonzero(left < 0)
            for i in known:
                row, first = table["docs"][i].values.to_numpy()[0], table["least"][i].as_py()
                spans = np.frombuffer(table["segment"][i].as_py(), np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spans), row)), pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(np.full(len(spans), first))], schema=INTERVALS)
            table = table.filter(pa.array(left >= 0))
            if not len(table):
                return
            h = table["h"].to_numpy()
            group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
            which, start, end, first = compare(group, table["left"].to_numpy(), table["segment"].to_pylist(), table["n"].to_numpy(), table["least"].to_numpy())
            if len(which):
                part = table.select(["docs", "at"]).take(pa.array(which)).combine_chunks()
                docs, at = (part[c].chunk(0) for c in ("docs", "at"))
                many = np.diff(docs.offsets.to_numpy())
                docs, at = docs.flatten().to_numpy(), at.flatten().to_numpy()
                start, end, first = at + np.repeat(start, many), at + np.repeat(end, many), np.repeat(first, many)
                for i in range(0, len(docs), 100_000):
                    j = i + 100_000
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i:j]), pa.array(start[i:j].astype(np.int32)), pa.array(end[i:j].astype(np.int32)), pa.array(first[i:j])], schema=INTERVALS)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > CHUNK:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                last = int(np.searchsorted(h, h[-1]))
                if last:
                    yield from out(table.slice(0, last))
                    held, size = table.slice(last).to_batches(), len(table) - last
        if held:
            yield from out(pa.Table.from_batches(held))

    sent = found.select("h", "left", "segment", "n", "least", "docs", "at").repartition(partitions(found.sparkSession), "h").sortWithinPartitions("h")
    return sent.mapInArrow(run, "row long, start int, end int, first long")


def with_spans(docs: DataFrame, intervals: DataFrame, first: bool = False) -> DataFrame:
    """`docs` (with `row`) and `spans`: for each row the intervals, each as start << 32 | end, null for none.

    With `first`, each is a struct of that and the interval's `first`.
    """
    span = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    if first:
        packed = intervals.select("row", F.struct(span.alias("span"), "first").alias("span")).groupBy("row").agg(F.collect_set("span").alias("spans"))
    else:
        packed = intervals.select("row", span.alias("span")).groupBy("row").agg(F.collect_set("span").alias("spans"))
    return docs.join(packed.hint("shuffle_hash"), "row", "left").select(*docs.columns, "spans")


def unpacked(spans) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list of such intervals as maximal runs."""
    from .common import merged

    if not spans.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = spans.values.to_numpy()
    return merged(both >> 32, both & 0xFFFFFFFF)
