"""Derived stores that are kept up to date: an inverted index and a graph of nearest neighbours, both in segments.

A change costs what it touches: the words of documents that come or go, and the lists of rows that gain or lose a neighbour. After any number of
changes both equal what is built anew from the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.segments import Segments
from ..sources.shared import materialised, place, state_of
from .index import Index
from .knn import CARRIED, DIGITS, HITS, Nearest, blocked, knn, matrix, stacked

# --- inverted index ---------------------------------------------------------------------------------------------------

INDEX = {"postings": "term string, id long, tf long, dl long", "docs": "id long, dl long, words array<struct<term: string, tf: bigint>>"}
TERMS = {"terms": "id string, df long, tf long"}


class KeptIndex:
    """The inverted index of documents (id, text) below a folder.

    Segments hold postings by term and the same words by document; a second store has the frequency of every term. A change takes the words of the
    documents that it replaces from the second table, so that terms' counts change by a difference.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.docs = Segments.opened(spark, f"{folder}/documents", INDEX)
        self.terms = Segments.opened(spark, f"{folder}/terms", TERMS)

    def broken(self) -> list[tuple[str, str, str]]:
        return self.docs.broken() + self.terms.broken()

    def changed(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None) -> KeptIndex:
        """The index after documents (id, text), one row an id, come or come anew, and those of some ids (id) go."""
        none = self.spark.createDataFrame([], "id long, text string")
        new = (none if upserts is None else upserts).select(F.col("id").cast("long").alias("id"), "text").where("id is not null")
        gone = none.select("id") if deleted is None else deleted.select(F.col("id").cast("long").alias("id")).where("id is not null")
        words = new.select("id", T.index_tokens("text").alias("w"))
        counted = words.select("id", F.size("w").cast("long").alias("dl"), F.explode_outer("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("term").alias("tf"))
        listed = counted.groupBy("id", "dl").agg(F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))).alias("words"))
        docs = materialised(listed.select("id", "dl", "words"), "index-docs")
        touched = materialised(docs.select("id").union(gone).distinct(), "index-touched")
        old = materialised(self.docs.of("docs", touched), "index-old")
        postings = docs.select("id", "dl", F.explode("words").alias("x")).select("x.term", "id", "x.tf", "dl")
        n, length = docs.agg(F.count("*"), F.sum("dl")).first()
        n_old, old_length = old.agg(F.count("*"), F.sum("dl")).first()
        number = self.docs.facts.get("change", 0) + 1
        n, length = self.docs.facts.get("n", 0) + n - n_old, self.docs.facts.get("length", 0) + (length or 0) - (old_length or 0)
        plus, minus = (t.select(F.explode("words").alias("x")).select(F.col("x.term").alias("id"), (F.col("x.tf") * s).alias("tf"), F.lit(s).alias("df")) for t, s in ((docs, 1), (old, -1)))
        # terms that a change leaves as often as before are not touched
        change = plus.union(minus).groupBy("id").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df <> 0 or tf <> 0")
        change = materialised(change, "index-change")
        before = self.terms.of("terms", change.select("id"))
        after = before.unionByName(change).groupBy("id").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")

        def mean(store: Segments) -> dict:
            """The mean inverse frequency of all terms, which depends on n: one pass over the terms."""
            raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
            return {"mean": store.live("terms").agg(F.avg(raw)).first()[0], "change": number}

        self.terms = self.terms.changed({"terms": after.select("id", "df", "tf").repartitionByRange("id").sortWithinPartitions("id")}, change.select("id"), mean)
        tables = {"postings": postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "docs": docs.repartitionByRange("id").sortWithinPartitions("id")}
        self.docs = self.docs.changed(tables, touched, lambda _: {"n": n, "length": length, "change": number})
        return self

    def index(self, floor: float = V.IDF_FLOOR) -> Index:
        """What bm25() takes. An index that has never been written is empty, and so is one that a change left halfway: its stores tell different changes."""
        n, length, mean = self.docs.facts.get("n", 0), self.docs.facts.get("length", 0), self.terms.facts.get("mean")
        if self.terms.facts.get("change") != self.docs.facts.get("change"):
            return KeptIndex(self.spark, f"{self.folder}/none").index()
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.lit(mean) * floor).otherwise(raw)
        terms = self.terms.live("terms").select(F.col("id").alias("term"), "df", "tf", idf.alias("idf"))
        size = self.spark.createDataFrame([(n, length / n if n else None)], "n long, avgdl double")
        return Index(self.docs.live("postings"), terms, size)

    def index_or_empty(self) -> tuple[Index, list[tuple[str, str, str]]]:
        """The index and nothing, or an empty one and what is broken."""
        wrong = self.broken()
        return (self.index() if not wrong else KeptIndex(self.spark, f"{self.folder}/none").index()), wrong


# --- nearest neighbours -----------------------------------------------------------------------------------------------

GRAPH = {"vectors": "id long, vector array<double>", "lists": "id long, near array<struct<id: bigint, score: double>>"}


def _best(rows: DataFrame, k: int) -> DataFrame:
    """(id, near): of neighbours (query_id, id, score) the k best of each, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "id")
    top = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    listed = F.sort_array(F.collect_list(F.struct("_n", "id", "score")))
    return top.groupBy(F.col("query_id").alias("id")).agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("near"))


def _gains(rows: DataFrame, added: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of `added` (id, vector) the k nearest to each of `rows` (id, vector, least), if they come before its last neighbour."""
    found = added.limit(CARRIED + 1).collect()

    def near(ids, m, least, new_ids, new):
        for s in range(0, len(ids), 256):
            score = m[s : s + 256] @ new.T
            rounded = np.round(score, DIGITS)
            i, j = np.nonzero(rounded >= np.round(least[s : s + 256, None], DIGITS))
            order = np.lexsort((new_ids[j], -rounded[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)
            some = np.arange(len(i)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 256][i[some]]), pa.array(new_ids[j[some]]), pa.array(score[i[some], j[some]])], schema=HITS)

    if len(found) <= CARRIED:
        new_ids, new = np.array([r.id for r in found], np.int64), stacked(found)

        def search(batches):
            for b in batches:
                if len(new_ids) and b.num_rows:
                    yield from near(b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy(), new_ids, new)

        return rows.mapInArrow(search, "query_id long, id long, score double")
    # as many as that: all their neighbours, block by block
    return blocked(added, rows.select("id", "vector"), lambda ids, m: Nearest(ids, m, k, False), "query_id long, id long, score double")


class KeptNeighbours:
    """The k nearest neighbours of every vector (id, vector) below a folder, and each row's mean similarity to them."""

    def __init__(self, spark: SparkSession, folder: str, k: int = V.HUBNESS_K):
        self.spark, self.k = spark, k
        self.store = Segments.opened(spark, folder, GRAPH)

    def changed(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None) -> KeptNeighbours:
        """The graph after vectors, one row an id, come or come anew, and those of some ids go.

        Rows that come have their neighbours searched, as have those that had a row that goes or comes anew as a neighbour (found by the reverse
        of the lists). All others keep their lists, and meet the rows that come, which may be nearer than their last one. Only lists that
        differ are written.
        """
        none = self.spark.createDataFrame([], GRAPH["vectors"])
        new = none if upserts is None else upserts.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
        new = materialised(new, "graph-new")
        gone = none.select("id") if deleted is None else deleted.select(F.col("id").cast("long").alias("id")).where("id is not null")
        touched = materialised(new.select("id").union(gone).distinct(), "graph-touched")
        rest = self.store.live("vectors").join(touched, "id", "left_anti")
        corpus = rest.unionByName(new) if self.store.parts else new
        lists = self.store.live("lists").join(touched, "id", "left_anti")
        reverse = lists.select("id", F.explode("near.id").alias("to"))
        stale = materialised(reverse.join(touched.withColumnRenamed("id", "to"), "to", "left_semi").select("id").distinct(), "graph-stale")
        again = new.unionByName(rest.join(stale, "id", "left_semi")) if self.store.parts else new
        found = materialised(_best(knn(corpus, again, self.k, exclude_self=True).select("query_id", "id", "score"), self.k), "graph-found")
        alone = again.select("id").join(found, "id", "left_anti").select("id", F.array().cast("array<struct<id: bigint, score: double>>").alias("near"))
        changed, vectors = found.unionByName(alone), new
        if self.store.parts:
            changed = self._met(lists.join(stale, "id", "left_anti"), rest, new, changed)
            # a list that changes is dead in earlier segments as a touched row's is; its vector is written with it
            vectors = new.unionByName(rest.join(changed.select("id"), "id", "left_semi").join(new.select("id"), "id", "left_anti"))
        tables = {"vectors": vectors, "lists": changed}
        all_touched = touched.union(changed.select("id"))
        self.store = self.store.changed(tables, all_touched, lambda s: {"mean": self._r(s).agg(F.avg("r")).first()[0], "written": changed.count()})
        return self

    def _met(self, kept: DataFrame, rest: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
        """`changed`, and the lists among `kept` that rows which come get into."""
        least = F.when(F.size("near") < self.k, F.lit(float("-inf"))).otherwise(F.element_at("near", -1)["score"])
        meeting = rest.join(kept.select("id", least.alias("least")), "id").select("id", "vector", "least")
        gains = materialised(_gains(meeting, new, self.k), "graph-gains")
        gainers = kept.join(gains.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), F.explode_outer("near").alias("x")).where("x is not null").select("query_id", "x.id", "x.score")
        return materialised(changed.unionByName(_best(gainers.unionByName(gains), self.k)), "graph-lists")

    @staticmethod
    def _r(store: Segments) -> DataFrame:
        total = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["score"])
        return store.live("lists").select("id", F.when(F.size("near") > 0, total / F.size("near")).otherwise(0.0).alias("r"))

    def hubness(self) -> DataFrame:
        """(id, r): the mean of each row's similarities to its neighbours."""
        return self._r(self.store)

    def mean(self) -> float | None:
        return self.store.facts.get("mean")

    def neighbours(self) -> DataFrame:
        """(query_id, id, score, rank)."""
        return self.store.live("lists").select(F.col("id").alias("query_id"), F.posexplode("near").alias("n", "x")).select("query_id", "x.id", "x.score", (F.col("n") + 1).alias("rank"))


_graphs: dict[tuple, KeptNeighbours] = {}


def graph_of(spark: SparkSession, path: str, id_: str, vector: str, k: int = V.HUBNESS_K) -> KeptNeighbours:
    """The graph of a table of files, built once for the table as it is and read by all queries after that."""
    key = (spark.sparkContext.applicationId, path, id_, vector, k, state_of(spark, path))
    if key not in _graphs:
        rows = spark.read.parquet(path).select(F.col(id_).alias("id"), F.col(vector).alias("vector"))
        _graphs[key] = KeptNeighbours(spark, place(spark, "neighbours"), k).changed(rows)
    return _graphs[key]
