"""Near-duplicate clusters: connected components over similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared.folder(df.sparkSession)
    return df.checkpoint()


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b): the smallest id reachable, by large-star and small-star rounds."""
    now = _cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = _cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        seen = state


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster_id, size, max_similarity, ids) of pairs (a, b, score), largest first."""
    pairs = _cut(pairs)  # used more than once
    found = components(pairs)
    best = pairs.join(found, pairs.a == found.id).groupBy("component").agg(F.round(F.max("score"), 4).alias("max_similarity"))
    members = found.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("ids"))
    return members.join(best, "component").select(F.col("component").alias("cluster_id"), "size", "max_similarity", "ids")
