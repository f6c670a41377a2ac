"""The query engine: rank fusion, hubness, calibration, deduplication and ordering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


# --- ranks and fusion -----------------------------------------------------------------------------------------------


def ranked(hits: DataFrame, k: int | None = None, *extra: Column) -> DataFrame:
    """Hits (query_id, id, score) with their rank: score to nine digits, then id."""
    order = Window.partitionBy("query_id").orderBy(*extra, F.round("score", 9).desc(), "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def rrf(lanes: list[tuple[str, DataFrame, float]], k: int = V.RRF_K) -> DataFrame:
    """(query_id, id, fused, weight_sum, <lane>_score ...) of lanes (name, hits with rank, weight).

    Lanes are unioned and summed, one shuffle for any number of them. A lane of weight 0 keeps its rows in the pool.
    """
    names = [name for name, _, _ in lanes]
    rows = None
    for name, hits, weight in lanes:
        lane = hits.select("query_id", "id", (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(name).alias("lane"), "score")
        rows = lane if rows is None else rows.unionByName(lane)
    total = float(sum(w for _, _, w in lanes))
    scores = [F.coalesce(F.max(F.when(F.col("lane") == n, F.col("score"))), F.lit(0.0)).alias(f"{n}_score") for n in names]
    return rows.groupBy("query_id", "id").agg(F.sum("part").alias("fused"), *scores).withColumn("weight_sum", F.lit(total))


def rrf_normalised(fused: Column, weight_sum: Column, k: int = V.RRF_K) -> Column:
    """The share of the best that all lanes could give, at most 1."""
    return F.when((weight_sum <= 0) | (fused <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), fused / (weight_sum / (k + 1))))


def hubness_adjusted(score: Column, r: Column, mean: Column, weight: float = V.HUBNESS_WEIGHT) -> Column:
    """A cosine less what its image is near to everything; an unknown image is average."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - weight * (F.coalesce(r, mean) - mean)))


def min_match(results: DataFrame, percent: int, relax: bool = True) -> DataFrame:
    """Rows of at least that percentage; with `relax`, all of a query's rows and `relaxed` if it has none."""
    meets = F.col("match_percent") >= percent
    some = F.max(meets).over(Window.partitionBy("query_id"))
    if not relax:
        return results.where(meets)
    return results.withColumn("_some", some).where(meets | ~F.col("_some")).withColumn("relaxed", ~F.col("_some")).drop("_some")


def boosted(score: Column, record_type: Column, wanted: Column, boost: float = V.ASSET_BOOST) -> Column:
    """What a row is sorted by: its score, raised where its asset type is the one that the query names."""
    return score * F.when(T.asset_type(record_type) == wanted, boost).otherwise(1.0)


def implied_type(query: Column) -> Column:
    """The one asset type that a short query names, or null."""
    words = T.tokens(query)
    kinds = F.array_distinct(F.filter(F.transform(words, T.query_asset_type), lambda t: t.isNotNull() & (t != "other")))
    return F.when((F.size(words) <= V.SHORT_TOKENS) & (F.size(kinds) == 1), kinds[0])


def greedy_dedupe(results: DataFrame, k: int, threshold: float = V.DEDUPE_SIMILARITY) -> DataFrame:
    """Of each query's rows, in order, those that don't repeat a kept one: same content hash or that cosine; at most k.

    Rows: (query_id, id, rank, content_hash, vector, tier); tier 1 fills up after tier 0, and a query without tier 0
    rows has no result. The order makes this a fold: a group is a query's pool, as large as its lanes together.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["tier", "rank", "id"]).reset_index(drop=True)
        width = max((len(v) for v in rows.vector if v is not None), default=1)
        unit = np.zeros((len(rows), width))
        for i, v in enumerate(rows.vector):
            if v is not None and len(v):
                unit[i, : len(v)] = v
        size = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        unit = np.divide(unit, size, out=np.zeros_like(unit), where=size > 0)
        # each kept row closes what repeats it, all at once
        open_ = np.full(len(rows), bool((rows.tier == 0).any()))
        hashes = rows.content_hash.fillna("").to_numpy()
        kept = []
        while len(kept) < k and open_.any():
            i = int(open_.argmax())
            kept.append(i)
            near = unit @ unit[i] >= threshold if size[i] > 0 else np.zeros(len(rows), bool)
            open_ &= ~near & ((hashes != hashes[i]) | (hashes == ""))
            open_[i] = False
        return pd.DataFrame({"query_id": rows.query_id[kept], "id": rows.id[kept], "kept_rank": np.arange(1, len(kept) + 1)})

    needed = results.select("query_id", "id", "rank", "content_hash", F.col("vector").cast("array<double>").alias("vector"), "tier")
    return needed.groupBy("query_id").applyInPandas(keep, "query_id long, id long, kept_rank int")


def sort_keys(key: str, created: str = "created_at", name: str = "name", source: str = "source_file", id_: str = "id", catalogue: bool = False) -> list[Column]:
    """Sort expressions of a result list; ties go by id. A catalogue sorts newest first with ids ascending."""
    low = lambda c: F.lower(T.strip(T.text_or_empty(c)))
    keys = {
        "newest": [F.col(created).desc(), F.col(id_).asc() if catalogue else F.col(id_).desc()],
        "oldest": [F.col(created).asc(), F.col(id_).asc()],
        "name": [low(name), F.col(id_).asc()],
        "source": [low(T.basename(source)) if not catalogue else F.lower(source), F.col(id_).asc()],
    }
    if key not in keys:
        raise ValueError(f"unknown sort: {key}")
    return keys[key]
