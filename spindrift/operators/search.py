"""The composed search: filters, three lanes, fusion, avoided terms, deduplication, minimum match and sort, for many queries at once.

Lanes are exact and limited to their pool sizes per query, so all that follows works on a few hundred rows a query: fusion
is one grouping, deduplication a fold per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .filters import Filters, allowed, avoids
from .index import Index, bm25
from .knn import knn
from .models import overlap_score
from .retrieval import greedy_dedupe, min_match, ranked, rrf, rrf_normalised, sort_keys

#: Lanes of the search and their weights; keywords add candidates, but no score.
WEIGHTS = {"dense": 1.0, "text": 1.0, "sparse": 0.0}


def candidates(queries: DataFrame, images: DataFrame, vectors: DataFrame, captions: DataFrame, index: Index, filters: Filters | None = None, restrict_to: list[int] | None = None, avoid: Sequence[str] = (), dense_k: int = V.DENSE_K, sparse_k: int = V.SPARSE_K, short_k: int = V.SHORT_K) -> DataFrame:
    """(query_id, id, fused, weight_sum, dense_score, text_score, sparse_score) of queries (query_id, vector, caption_vector, text).

    `vectors` and `captions`: (image_id, vector). With filters the lanes search what they allow; without, they search all and
    hits that are deleted or unknown go afterwards, so a lane may come out shorter. A query of few words is vague: its lanes
    are `short_k` long.
    """
    short = F.size(T.tokens("text")) <= V.SHORT_TOKENS
    pools = queries.select("query_id", F.when(short, short_k).otherwise(dense_k).alias("_dense"), F.when(short, short_k).otherwise(sparse_k).alias("_sparse"))

    def cut(hits: DataFrame, pool: str) -> DataFrame:
        return hits.join(pools, "query_id").where(F.col("rank") <= F.col(pool)).drop("_dense", "_sparse")

    live = images.where("not deleted")
    inside = allowed(live, filters or Filters(), restrict_to)
    within = (lambda df: df) if inside is None else (lambda df: df.join(inside, "image_id", "left_semi"))
    lanes = []
    for name, corpus, column in (("dense", vectors, "vector"), ("text", captions, "caption_vector")):
        asked = queries.select(F.col("query_id").alias("image_id"), F.col(column).alias("vector"))
        lanes.append((name, cut(knn(within(corpus), asked, max(dense_k, short_k), "image_id"), "_dense"), WEIGHTS[name]))
    sparse = bm25(index, queries, max(sparse_k, short_k), only=None if inside is None else inside.select(F.col("image_id").alias("id")))
    lanes.append(("sparse", cut(sparse, "_sparse"), WEIGHTS["sparse"]))
    if inside is None:
        known = live.select(F.col("image_id").alias("id"))
        # ranks are counted again without the hits that go
        lanes = [(name, ranked(hits.join(known, "id", "left_semi").drop("rank")), weight) for name, hits, weight in lanes]
    found = rrf(lanes).withColumn("weight_sum", F.lit(WEIGHTS["dense"] + WEIGHTS["text"]))
    if any(t.strip() for t in avoid):
        found = found.join(avoids(images, list(avoid)).select(F.col("image_id").alias("id")), "id", "left_semi")
    return found


def results(found: DataFrame, images: DataFrame, vectors: DataFrame, top_k: int, min_percent: int = 0, relax: bool = True, sort: str | None = None) -> DataFrame:
    """(query_id, id, rank, score, match_percent, relaxed) of candidates: fused order, near duplicates dropped, at most `top_k`."""
    records = images.select(F.col("image_id").alias("id"), "content_hash", "created_at", F.col("caption_short").alias("name"), "source_file")
    scored = found.withColumn("score", rrf_normalised(F.col("fused"), F.col("weight_sum"))).join(records, "id")
    order = ranked(scored.select("query_id", "id", "score", "content_hash", "created_at", "name", "source_file"))
    pool = order.join(vectors.select(F.col("image_id").alias("id"), "vector"), "id", "left").withColumn("tier", F.lit(0))
    kept = greedy_dedupe(pool, max(1, min(top_k, 50)))
    shown = kept.join(order.drop("rank"), ["query_id", "id"]).withColumn("match_percent", T.match_percent(F.round("score", 9), F.lit("fusion")))
    shown = min_match(shown, min_percent, relax) if min_percent > 0 else shown
    if "relaxed" not in shown.columns:
        shown = shown.withColumn("relaxed", F.lit(False))
    by = sort_keys(sort) if sort else [F.col("kept_rank")]
    numbered = shown.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return numbered.select("query_id", "id", "rank", "score", "match_percent", "relaxed")


def similar(references: DataFrame, images: DataFrame, vectors: DataFrame, index: Index, axis: str = "balanced", top_k: int = V.TOP_K, min_percent: int = 0, sort: str | None = None) -> DataFrame:
    """Images like each of `references` (query_id = image_id, vector, text): the visual lane and a scored text leg, fused by axis.

    The reference itself is in neither lane. The text leg is the keyword lane scored again by the model hook.
    """
    live = images.where("not deleted").select("image_id")
    visual_k = min(V.DENSE_K, max(top_k * 5, 25))
    visual = knn(vectors.join(live, "image_id", "left_semi"), references.select(F.col("query_id").alias("image_id"), "vector"), visual_k, "image_id").where("id <> query_id").drop("rank")
    pool = bm25(index, references, V.RERANK_N, only=live.select(F.col("image_id").alias("id"))).where("id <> query_id").select("query_id", "id")
    asked = references.select("query_id", F.col("text").alias("asked"))
    documents = images.select(F.col("image_id").alias("id"), F.concat_ws(" ", "caption_short", "caption_detailed").alias("document"))
    text = pool.join(asked, "query_id").join(documents, "id").select("query_id", "id", overlap_score(F.col("asked"), F.col("document")).alias("score"))
    a, b = V.AXIS_WEIGHTS[axis]
    lanes = [("dense", ranked(visual), a), ("text", ranked(text, top_k), b)]
    both = rrf(lanes)
    # a lane without hits for a query has no part in what its best could be
    there = None
    for (name, hits, weight) in lanes:
        part = hits.select("query_id").distinct().withColumn("w", F.lit(weight))
        there = part if there is None else there.union(part)
    total = there.groupBy("query_id").agg(F.sum("w").alias("weight_sum"))
    head = ranked(both.drop("weight_sum").join(total, "query_id").withColumn("score", F.col("fused")), max(top_k * 5, top_k))
    return results(head.select("query_id", "id", "fused", "weight_sum"), images, vectors, top_k, min_percent, relax=False, sort=sort)
