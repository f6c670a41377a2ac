"""The lab: named ranking variants over one pool of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import retrieval as R
from ..operators.models import overlap_score
from ..sources.shared import materialised

TOP_K = 20
#: name: ((weight of visual, text and sparse lane; None: not there), k of the fusion, whether the scoring model filters the pool first).
FUSED = {
    "visual_text": ((1.0, 1.0, None), 60, False),
    "rrf_fusion": ((1.0, 1.0, 1.0), 60, False),
    "visual_text_visual_heavy": ((2.0, 1.0, None), 60, False),
    "visual_text_text_heavy": ((1.0, 2.0, None), 60, False),
    "visual_text_hubness": ((1.0, 1.0, None), 60, False),
    "visual_text_k10": ((1.0, 1.0, None), 10, False),
    "visual_text_k30": ((1.0, 1.0, None), 30, False),
    "visual_text_k120": ((1.0, 1.0, None), 120, False),
    "cohere_filter_rrf_3lane": ((1.0, 1.0, 1.0), 60, True),
    "cohere_filter_visual_text": ((1.0, 1.0, None), 60, True),
}
#: name: the one lane whose score ranks the pool.
SINGLE = {"visual_raw": "dense", "caption_text": "text"}
LANES = ("dense", "text", "sparse")
#: The pool as SQL, over views dense, text, sparse (id, score, rank) and images.
POOL_SQL = """, hits AS (SELECT id, 'd' AS lane, score FROM dense UNION ALL SELECT id, 't', score FROM text UNION ALL SELECT id, 's', score FROM sparse),
pool AS (SELECT id, coalesce(max(score) FILTER (lane = 'd'), 0e0) AS dense, coalesce(max(score) FILTER (lane = 't'), 0e0) AS text, coalesce(max(score) FILTER (lane = 's'), 0e0) AS sparse
  FROM hits WHERE id IN (SELECT image_id FROM images WHERE NOT deleted) GROUP BY id)"""
_LAST = " row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM g QUALIFY rank <= 20"


def _many_sql(name: str, overlap: str) -> str:
    """One variant's rankings for all queries, over views lanes (query_id, id, dense, text, sparse) and asked (query_id, text)."""
    weights, k, filtered = FUSED.get(name, ((None, None, None), None, False))
    source = "kept" if filtered else "pool"
    if name in SINGLE:
        fused = f"SELECT query_id, id, {SINGLE[name]} AS score FROM pool WHERE {SINGLE[name]} > 0"
    else:
        total = sum(w for w in weights if w)
        parts = " UNION ALL ".join(
            f"SELECT query_id, id, {w}e0 / ({k} + row_number() OVER (PARTITION BY query_id ORDER BY round({lane}, 9) DESC, id)) AS part FROM {source} WHERE {lane} > 0" for lane, w in zip(LANES, weights) if w is not None
        )
        fused = f"SELECT query_id, id, least(1e0, sum(part) / ({total}e0 / ({k} + 1))) AS score FROM ({parts}) GROUP BY query_id, id"
    return f"SELECT query_id, '{name}' AS variant, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, CAST(NULL AS VARCHAR) AS error FROM ({fused}) QUALIFY rank <= {TOP_K}"


def comparison_sql(overlap: str) -> str:
    """All variants for all queries; `overlap` is the scoring model's value for text and query."""
    views = f""", scored AS (SELECT pool.*, {overlap} AS model FROM pool JOIN asked USING (query_id) JOIN documents ON doc_id = pool.id),
head AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(model, 9) DESC, id) <= {TOP_K}),
kept AS (SELECT * FROM head QUALIFY model >= 0.25e0 OR max(model) OVER (PARTITION BY query_id) < 0.25e0)"""
    return views + " " + " UNION ALL ".join(f"({_many_sql(name, overlap)})" for name in (*SINGLE, *FUSED))


def _fused_sql(name: str, overlap: str) -> str:
    weights, k, filtered = FUSED[name]
    pool = ""
    source = "pool"
    if filtered:
        pool = f""", scored AS (SELECT pool.*, model FROM pool JOIN (SELECT doc_id, {overlap} AS model FROM documents) m ON m.doc_id = pool.id),
head AS (SELECT * FROM scored ORDER BY round(model, 9) DESC, id LIMIT {TOP_K}), kept AS (SELECT * FROM head WHERE model >= 0.25e0 UNION ALL SELECT * FROM head WHERE NOT EXISTS (FROM head WHERE model >= 0.25e0))"""
        source = "kept"
    lanes = " UNION ALL ".join(f"SELECT id, {w}e0 AS w, row_number() OVER (ORDER BY round({lane}, 9) DESC, id) AS rank FROM {source} WHERE {lane} > 0" for lane, w in zip(LANES, weights) if w is not None)
    total = sum(w for w in weights if w)
    return f"{POOL_SQL}{pool}, f AS (SELECT id, sum(w / ({k} + rank)) AS fused FROM ({lanes}) GROUP BY id), g AS (SELECT id, least(1e0, fused / ({total}e0 / ({k} + 1))) AS score FROM f) SELECT '{name}' AS variant, id, round(score, 6) AS score,{_LAST}"


def lab_sql(overlap: str) -> dict[str, str]:
    """Each variant's SELECT; `overlap` is the scoring model's value for a row of documents."""
    single = {name: f"{POOL_SQL}, g AS (SELECT id, {lane} AS score FROM pool WHERE {lane} > 0) SELECT '{name}' AS variant, id, round(score, 6) AS score,{_LAST}" for name, lane in SINGLE.items()}
    return single | {name: _fused_sql(name, overlap) for name in FUSED}


def pool(visual: DataFrame, text: DataFrame, sparse: DataFrame, active: DataFrame) -> DataFrame:
    """(query_id, id, dense_score, text_score, sparse_score): what any lane found among `active` (image_id)."""
    found = R.rrf([("dense", visual, 1.0), ("text", text, 1.0), ("sparse", sparse, 0.0)])
    return found.join(active.select(F.col("image_id").alias("id")), "id", "left_semi").select("query_id", "id", *(f"{lane}_score" for lane in LANES))


def _lane(found: DataFrame, name: str) -> DataFrame:
    return R.ranked(found.where(F.col(f"{name}_score") > 0).select("query_id", "id", F.col(f"{name}_score").alias("score")))


def filtered(found: DataFrame, query: str, documents: DataFrame) -> DataFrame:
    """The pool's best `TOP_K` by the scoring model: those of `WEAK_SCORE` or more, all of them if none is."""
    scored = found.join(documents, "id").withColumn("score", overlap_score(F.lit(query), F.col("document"))).drop("document")
    head = R.ranked(scored, TOP_K)
    return R.min_match(head.withColumn("match_percent", F.col("score")), V.WEAK_SCORE).select(*found.columns)


def compared(found: DataFrame, name: str, query: str, documents: DataFrame) -> DataFrame:
    """One variant's ranking of the pool; `documents`: (id, document) for the scoring model."""
    if name in SINGLE:
        out = _lane(found, SINGLE[name])
    else:
        weights, k, by_model = FUSED[name]
        if by_model:
            found = filtered(found, query, documents)
        # hubness changes the scores of the visual lane, not its order, and fusion looks at the order only
        lanes = [(lane, _lane(found, lane), w) for lane, w in zip(LANES, weights) if w is not None]
        fused = R.rrf(lanes, k)
        out = fused.withColumn("score", R.rrf_normalised(F.col("fused"), F.col("weight_sum"), k)).select("query_id", "id", "score")
    top = R.ranked(out.select("query_id", "id", "score"), TOP_K)
    return top.select(F.lit(name).alias("variant"), "id", F.round("score", 6).alias("score"), "rank")


def variants(spark) -> DataFrame:
    """(variant, lane, weight, k, total, by_model): a row for each lane of each variant; without `k` the lane's score is the variant's."""
    rows = [(name, lane, 1.0, None, 1.0, False) for name, lane in SINGLE.items()]
    for name, (weights, k, by_model) in FUSED.items():
        rows += [(name, lane, w, k, float(sum(x for x in weights if x)), by_model) for lane, w in zip(LANES, weights) if w is not None]
    return spark.createDataFrame(rows, "variant string, lane string, weight double, k int, total double, by_model boolean")


def overlap_model(query: Column, text: Column) -> Column:
    """The scoring model's stand-in as (score, error)."""
    return F.struct(overlap_score(query, text).alias("score"), F.lit(None).cast("string").alias("error"))


def comparison(found: DataFrame, queries: DataFrame, documents: DataFrame, model=overlap_model, top_k: int = TOP_K) -> DataFrame:
    """(query_id, variant, id, score, rank, error): the rankings by all variants of every query's pool `found`, in one plan.

    The pool is written once and scored once by `model(text of the query, document)`, a column of (score, error). Ranks within the lanes are taken twice,
    in the pool and in what the model leaves of it; variants are a table of weights that meets them, and fusion is one grouping. Where the model
    fails on a row of a query's pool, the variants that need it are one row of that query, with the error, and the others are whole.
    `queries`: (query_id, text); `documents`: (id, document).
    """
    rows = found.join(queries, "query_id").join(documents, "id").withColumn("model", model(F.col("text"), F.col("document")))
    rows = materialised(rows.select("query_id", "id", *(f"{lane}_score" for lane in LANES), F.col("model.score").alias("model"), F.col("model.error").alias("error")), "lab-pool")
    failed = rows.groupBy("query_id").agg(F.min("error").alias("error"))
    # what the model leaves: the best by its score, those that reach the threshold or else all of them
    head = R.ranked(rows.select("query_id", "id", F.col("model").alias("score")), top_k)
    kept = R.min_match(head.withColumn("match_percent", F.col("score")), V.WEAK_SCORE).select("query_id", "id", F.lit(True).alias("kept"))
    marked = rows.join(kept, ["query_id", "id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    lane = F.explode(F.array(*(F.struct(F.lit(lane).alias("lane"), F.col(f"{lane}_score").alias("score")) for lane in LANES)))
    hits = marked.select("query_id", "id", "kept", lane.alias("x")).select("query_id", "id", "kept", "x.lane", "x.score").where("score > 0")
    by_score = [F.round("score", 9).desc(), F.col("id")]
    hits = hits.withColumn("in_pool", F.row_number().over(Window.partitionBy("query_id", "lane").orderBy(*by_score)))
    hits = hits.withColumn("in_kept", F.row_number().over(Window.partitionBy("query_id", "lane", "kept").orderBy(*by_score)))
    met = hits.join(F.broadcast(variants(found.sparkSession)), "lane").where("kept or not by_model")  # some dozens of rows
    place = F.when(F.col("by_model"), F.col("in_kept")).otherwise(F.col("in_pool"))
    part = F.when(F.col("k").isNull(), F.col("score")).otherwise(F.col("weight") / (F.col("k") + place))
    fused = met.withColumn("part", part).groupBy("variant", "query_id", "id", "k", "total", "by_model").agg(F.sum("part").alias("fused"))
    best = F.when(F.col("k").isNull(), F.col("fused")).otherwise(F.least(F.lit(1.0), F.col("fused") / (F.col("total") / (F.col("k") + 1))))
    ranks = F.row_number().over(Window.partitionBy("variant", "query_id").orderBy(*by_score))
    scored = fused.withColumn("score", best).withColumn("rank", ranks).where(F.col("rank") <= top_k).join(failed, "query_id")
    good = scored.where(~F.col("by_model") | F.col("error").isNull()).select("query_id", "variant", "id", F.round("score", 6).alias("score"), "rank", F.lit(None).cast("string").alias("error"))
    models = found.sparkSession.createDataFrame([(n,) for n, (_, _, by_model) in FUSED.items() if by_model], "variant string")
    none = F.lit(None)
    lost = failed.where("error is not null").join(F.broadcast(models)).select("query_id", "variant", none.cast("long").alias("id"), none.cast("double").alias("score"), none.cast("int").alias("rank"), "error")
    return good.unionByName(lost)
