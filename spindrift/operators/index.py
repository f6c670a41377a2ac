"""The inverted index: postings and statistics of terms, written once for a table and read by term.

Postings lie in ranges of terms, sorted by term, so that a query's terms are a filter that reaches the scan and skips all
other row groups. The index of a table of files is built at its first use in a session and again when its files change.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.shared import materialised, state_of
from .knn import Best, held_then_passed, tasks_for
from .retrieval import ranked

#: Terms of queries that become a filter on the scan; more of them are joined.
LISTED = 10_000
#: Words that a task counts at once, postings of a partition that is sorted.
COUNTED, SORTED = 500_000, 2_000_000
#: Queries whose hits are added up as rows; more are met in blocks. Queries that a task holds, terms that travel with the tasks, documents and postings
#: that are scored at once, postings of a task.
FEW, ASKED, TRAVELLING = 8, 20_000, 200_000
DOCUMENTS, SCORED, PASSED = 8_192, 1_000_000, 4_000_000


@dataclass
class Index:
    """postings (term, id, tf, dl), terms (term, df, tf, idf) and size, one row (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    size: DataFrame


def postings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(term, id, tf, dl): one row per row and term. A row has all its words, so nothing is dealt out to count them."""

    def count(batches):
        for b in batches:
            ids, words = b.column(0), b.column(1)
            ends = np.cumsum(pc.list_value_length(words).to_numpy())
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COUNTED, "right")))
                part = words.slice(first, last - first)
                own = pc.list_value_length(part).to_numpy().astype(np.int64)
                coded = part.flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(len(own)), own) * many + coded.indices.to_numpy(), return_counts=True)
                row = key // many
                for i in range(0, len(key), 50_000):
                    r = row[i : i + 50_000]
                    term = coded.dictionary.take(pa.array(key[i : i + 50_000] % many))
                    yield pa.RecordBatch.from_arrays([term, ids.take(pa.array(r + first)), pa.array(tf[i : i + 50_000]), pa.array(own[r])], names=["term", "id", "tf", "dl"])
                first = last

    kind = docs.select(id_).schema[0].dataType.simpleString()
    return docs.select(F.col(id_).alias("id"), T.index_tokens(text).alias("words")).mapInArrow(count, f"term string, id {kind}, tf long, dl long")


def terms(posted: DataFrame, size: DataFrame, floor: float = V.IDF_FLOOR) -> DataFrame:
    """(term, df, tf, idf): a negative idf becomes a share of the mean idf over all terms."""
    raw = posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).join(F.broadcast(size.select("n")))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", "tf", F.when(F.col("raw") < 0, F.col("mean") * floor).otherwise(F.col("raw")).alias("idf"))


def built(docs: DataFrame, id_: str, text: str) -> Index:
    """The index, written to the shared folder."""
    counted = materialised(postings(docs, id_, text), "postings-counted")  # ranges are cut from a sample of these
    n, most = docs.groupBy(id_).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if most is not None and most > 1:  # rows of one id
        counted = counted.groupBy("term", "id", "dl").agg(F.sum("tf").alias("tf")).select("term", "id", "tf", "dl")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // SORTED))
    posted = materialised(counted.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id"), "postings")
    # the mean length follows from the postings: texts are cut into words once
    size = materialised(posted.agg(F.lit(n).cast("long").alias("n"), F.try_divide(F.sum("tf"), F.lit(n)).alias("avgdl")), "index-size")
    counted = materialised(terms(posted, size).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    return Index(posted, counted, size)


_indexes: dict[tuple, Index] = {}


def stored(spark: SparkSession, path: str, id_: str, text: str) -> Index:
    """The index of a table of files, built once for the table as it is now; a query asks for the state of its folder, not of its files."""
    key = (spark.sparkContext.applicationId, path, id_, text, state_of(spark, path))
    if key not in _indexes:
        _indexes[key] = built(spark.read.parquet(path), id_, text)
    return _indexes[key]


def bm25(index: Index, queries: DataFrame, k: int, only: DataFrame | None = None, k1: float = V.K1, b: float = V.B) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, text); a repeated word counts again; scores of 0 or less go.

    `only`: (id) of the documents that may be found.
    """
    words = queries.select("query_id", F.explode(T.index_tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    many = queries.limit(FEW + 1).count() > FEW
    words = materialised(words, "words-asked") if many else words
    posted, weights = index.postings, index.terms
    wanted = [r.term for r in words.select("term").distinct().limit(LISTED + 1).collect()]
    if len(wanted) <= LISTED:
        posted, weights = posted.where(F.col("term").isin(wanted)), weights.where(F.col("term").isin(wanted))
    if many:
        return ranked(_met(index, posted, weights, words, part, k, only), k)
    if only is not None:
        posted = posted.join(only, "id", "left_semi")
    hit = posted.join(weights.select("term", "idf"), "term").join(F.broadcast(words), "term").join(F.broadcast(index.size))
    return ranked(hit.groupBy("query_id", "id").agg(F.sum(F.col("times") * part).alias("score")).where("score > 0"), k)


def _met(index: Index, posted: DataFrame, weights: DataFrame, words: DataFrame, part: Column, k: int, only: DataFrame | None) -> DataFrame:
    """(query_id, id, score): among others the k best of each query of `words` (query_id, term, times).

    A posting is dealt out once, whatever the number of queries that ask for it (up to ASKED): a task holds the words of its queries while blocks of
    documents pass, each document whole, and keeps the k best of each query.
    """
    asked = materialised(words.groupBy("term").agg(F.count("*").alias("n")).join(weights.select("term", "idf", "df"), "term").withColumn("code", F.monotonically_increasing_id()).select("term", "code", "idf", "df"), "terms-asked")
    terms, postings_ = asked.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    small = F.broadcast if terms <= TRAVELLING else (lambda df: df)
    coded = posted.join(small(asked.select("term", "code", "idf")), "term").join(F.broadcast(index.size)).select("id", "code", part.alias("weight"))
    if only is not None:
        coded = coded.join(only.distinct(), "id", "left_semi")
    sets = max(1, -(-words.select("query_id").distinct().count() // ASKED))
    blocks = max(1, -(-index.size.first().n // DOCUMENTS), -(-postings_ // SCORED))
    parts = min(blocks, max(tasks_for(words, sets, blocks * DOCUMENTS), -(-postings_ // PASSED)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    cell = (F.col("i") * parts + F.col("j")).alias("task")
    held = words.join(small(asked.select("term", "code")), "term").withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int"))
    held = held.select("i", every(parts).alias("j"), "query_id", "code", "times").select(cell, F.lit(0).alias("side"), F.lit(0).alias("block"), F.col("query_id").cast("long").alias("id"), "code", F.col("times").cast("double").alias("weight"))
    passing = coded.withColumn("block", block).select(every(sets).alias("i"), (F.col("block") % parts).alias("j"), "block", "id", "code", "weight")
    passing = passing.select(cell, F.lit(1).alias("side"), "block", F.col("id").cast("long").alias("id"), "code", "weight")
    return held_then_passed(held.union(passing), sets * parts, ["block"], lambda table: Asked(table, k), "query_id long, id long, score double")


class Asked:
    """Some queries' words, and their k best documents so far as blocks of documents pass."""

    def __init__(self, table: pa.Table, k: int):
        query, code, times = (table.column(n).to_numpy() for n in (3, 4, 5))
        order = np.lexsort((code, query))  # equal documents get equal sums
        query, self.code, self.times = query[order], code[order], times[order]
        ids, first = np.unique(query, return_index=True)
        self.ends = np.r_[first, len(query)]
        self.best, self.block, self.parts = Best(ids, k), None, []

    def add(self, b: pa.RecordBatch) -> tuple:
        blocks = b.column(2).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
        for f, t in zip(cuts[:-1], cuts[1:]):
            if blocks[f] != self.block:
                self._score()
                self.block = blocks[f]
            self.parts.append([b.column(n).to_numpy()[f:t].copy() for n in (3, 4, 5)])
        return ()

    def _score(self) -> None:
        """The block that has passed, 64 queries at a time."""
        if not self.parts:
            return
        ids, code, weight = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.argsort(code, kind="stable")
        ids, local = np.unique(ids, return_inverse=True)
        code, local, weight = code[order], local[order], weight[order]
        codes, first = np.unique(code, return_index=True)
        at = {c: (local[f:t], weight[f:t]) for c, f, t in zip(codes.tolist(), first, np.r_[first[1:], len(code)])}
        for s in range(0, len(self.best.ids), 64):
            score = np.zeros((min(64, len(self.best.ids) - s), len(ids)))
            for r, row in enumerate(score):
                f, t = self.ends[s + r], self.ends[s + r + 1]
                for c, times in zip(self.code[f:t].tolist(), self.times[f:t].tolist()):
                    if c in at:
                        to, w = at[c]  # a document has a term once
                        row[to] += w if times == 1 else times * w
            i, j = np.nonzero((score > 0) & (score >= self.best.floor(s, score, 2e-9)[:, None]))
            self.best.take(s, i, ids[j], score[i, j])

    def found(self):
        self._score()
        yield from self.best.found()
