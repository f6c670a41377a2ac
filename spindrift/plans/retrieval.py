"""Queries of vectors, the sparse lane, fusion and ranking (V, J, W, O of results)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.vectors import cosine, normalised
from ..operators import analytics as A
from ..operators import retrieval as R
from ..operators.clusters import clusters
from ..operators.filters import Filters
from ..operators.index import bm25, stored
from ..operators.kept import KeptNeighbours, graph_of
from ..operators.knn import knn
from ..operators.metric import similar_classes, similar_pairs
from ..operators.ordering import numbered
from ..operators.search import candidates, results, similar
from ..sources.shared import place
from .lab import compared, comparison, comparison_sql, lab_sql, pool
from .registry import query
from .views import active, images, sql, table, vectors

_REF = "(SELECT vector FROM vectors WHERE image_id = 0)"
_QUERY = "there erent with"
#: Views of the two lanes of the flagship query: cosine to vector 0, and BM25 of three words.
_LANES = f""", docs AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
post AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM docs) GROUP BY id, len(w), term),
raw AS (SELECT term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
bm AS (SELECT id, sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM post JOIN idf USING (term), size WHERE term IN ('there', 'erent', 'with') GROUP BY id HAVING score > 0),
sparse AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 50),
cos AS (SELECT image_id AS id, list_cosine_similarity(vector, {_REF}) AS score FROM vectors),
dense AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM cos QUALIFY rank <= 50)"""


def graph(spark, d):
    """The nearest neighbours of all vectors, built once for the table."""
    return graph_of(spark, f"{d}/embeddings.parquet", "vec_id", "embedding", V.HUBNESS_K)


def dense_lane(spark, d, k: int = V.DENSE_K, ref: int = 0):
    v = vectors(spark, d)
    return knn(v, v.where(F.col("image_id") == ref), k, "image_id").withColumn("query_id", F.lit(0).cast("long"))


def sparse_lane(spark, d, k: int = V.SPARSE_K, text: str = _QUERY):
    q = spark.createDataFrame([(0, text)], "query_id long, text string")
    return bm25(stored(spark, f"{d}/documents.parquet", "doc_id", "text"), q, k)


def flagship(spark, d):
    """Two lanes, fused: the ten best with their match percentage."""
    fused = R.rrf([("dense", dense_lane(spark, d), 1.0), ("sparse", sparse_lane(spark, d), 1.0)])
    score = R.rrf_normalised(F.col("fused"), F.col("weight_sum"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    top = R.ranked(fused.withColumn("score", score), 10).select("id", "rank", F.round("score", 6).alias("score"), T.match_percent(F.round("score", 9), F.lit("fusion")).alias("match_percent"))
    return top.join(docs, "id", "left")


query("v11_hybrid_search", sql("vectors", _LANES + """, f AS (SELECT id, sum(1e0 / (60 + rank)) AS fused FROM (SELECT id, rank FROM dense UNION ALL SELECT id, rank FROM sparse) GROUP BY id),
g AS (SELECT id, least(1e0, fused / (2e0 / 61)) AS score FROM f), t AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM g QUALIFY rank <= 10)
SELECT id, rank, round(score, 6) AS score, CAST(round_even(round(score, 9) * 100e0, 0) AS INTEGER) AS match_percent, lang, source FROM t LEFT JOIN documents ON doc_id = id"""))(flagship)


@query("v01_cosine", sql("vectors", "SELECT a.image_id AS a, r.b, round(list_cosine_similarity(a.vector, r.vector), 6) AS score FROM vectors a JOIN (SELECT label, min(image_id) AS b, arg_min(vector, image_id) AS vector FROM vectors GROUP BY label) r ON a.label = r.label"))
def cosine_(spark, d):
    """Every vector with the first one of its label."""
    v = vectors(spark, d)
    first = v.groupBy("label").agg(F.min("image_id").alias("b"), F.min_by("vector", "image_id").alias("first"))
    return v.join(first, "label").select(F.col("image_id").alias("a"), "b", F.round(cosine("vector", "first"), 6).alias("score"))


@query("v02_normalised", sql("vectors", "SELECT image_id, round(list_sum(list_transform(vector, lambda x: x * x * 9e0)) / 9e0, 4) AS squared FROM vectors"))
def normalised_(spark, d):
    v = vectors(spark, d).withColumn("n", normalised(F.transform("vector", lambda x: x * 3)))
    return v.select("image_id", F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squared"))


@query("v03_dense_lane", sql("vectors", f", s AS (SELECT image_id AS id, list_cosine_similarity(vector, {_REF}) AS score FROM vectors) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 50"))
def dense(spark, d):
    return dense_lane(spark, d).select("id", F.round("score", 6).alias("score"), "rank")


@query("v04_text_lane", sql("vectors", ", s AS (SELECT image_id AS id, list_cosine_similarity(vector, (SELECT vector FROM vectors WHERE image_id = 9)) AS score FROM vectors) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 100"))
def text_lane(spark, d):
    return dense_lane(spark, d, 100, 9).select("id", F.round("score", 6).alias("score"), "rank")


@query("v06_bm25_build", sql("vectors", _LANES + " SELECT term, count(*) AS df, sum(tf) AS tf, round(any_value(idf), 6) AS idf FROM post JOIN idf USING (term) GROUP BY term"))
def bm25_build(spark, d):
    return stored(spark, f"{d}/documents.parquet", "doc_id", "text").terms.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query("v07_bm25_query", sql("vectors", _LANES + " SELECT id, round(score, 6) AS score, rank FROM sparse"))
def bm25_query(spark, d):
    return sparse_lane(spark, d).select("id", F.round("score", 6).alias("score"), "rank")


@query("v08_rrf_two_lanes", sql("vectors", _LANES + " SELECT id, round(sum(w / (60 + rank)), 9) AS fused FROM (SELECT id, rank, 0.35e0 AS w FROM dense UNION ALL SELECT id, rank, 1.65e0 FROM sparse) GROUP BY id"))
def rrf_two(spark, d):
    return R.rrf([("dense", dense_lane(spark, d), 0.35), ("sparse", sparse_lane(spark, d), 1.65)]).select("id", F.round("fused", 9).alias("fused"))


_THREE = _LANES + ", c9 AS (SELECT image_id AS id, list_cosine_similarity(vector, (SELECT vector FROM vectors WHERE image_id = 9)) AS score FROM vectors), text AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM c9 QUALIFY rank <= 50)"


@query("v09_rrf_three_lanes", sql("vectors", _THREE + " SELECT id, round(sum(w / (60 + rank)), 9) AS fused, round(coalesce(max(CASE WHEN lane = 'd' THEN score END), 0), 6) AS dense_score, round(coalesce(max(CASE WHEN lane = 's' THEN score END), 0), 6) AS sparse_score FROM (SELECT id, rank, score, 1e0 AS w, 'd' AS lane FROM dense UNION ALL SELECT id, rank, score, 1e0, 't' FROM text UNION ALL SELECT id, rank, score, 0e0, 's' FROM sparse) GROUP BY id"))
def rrf_three(spark, d):
    lanes = [("dense", dense_lane(spark, d), 1.0), ("text", dense_lane(spark, d, 50, 9), 1.0), ("sparse", sparse_lane(spark, d), 0.0)]
    return R.rrf(lanes).select("id", F.round("fused", 9).alias("fused"), F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"))



_KNN = "SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT a.image_id AS query_id, b.image_id AS id, list_cosine_similarity(a.vector, b.vector) AS score, row_number() OVER (PARTITION BY a.image_id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 9) DESC, b.image_id) AS rank FROM vectors a JOIN vectors b ON {on}) WHERE rank <= {k}"
_HUB = ", p AS (SELECT a.image_id AS id, list_cosine_similarity(a.vector, b.vector) AS s, row_number() OVER (PARTITION BY a.image_id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 9) DESC, b.image_id) AS n FROM vectors a JOIN vectors b ON a.image_id <> b.image_id), hub AS (SELECT id, avg(s) AS r FROM p WHERE n <= 10 GROUP BY id)"


@query("v12_hubness", sql("vectors", _HUB + " SELECT id, round(r, 6) AS r FROM hub"))
def hubness_(spark, d):
    return graph(spark, d).hubness().select("id", F.round("r", 6).alias("r"))


_ADJ = _HUB + f", adj AS (SELECT c.id, greatest(0e0, least(1e0, c.score - 0.5e0 * (coalesce(r, (SELECT avg(r) FROM hub)) - (SELECT avg(r) FROM hub)))) AS score FROM (SELECT image_id AS id, list_cosine_similarity(vector, {_REF}) AS score FROM vectors) c LEFT JOIN hub USING (id))"


def adjusted(spark, d, lane):
    """A lane's scores less what their rows are near to all others, both read from the kept graph."""
    near = graph(spark, d)
    return lane.join(near.hubness(), "id", "left").withColumn("mean", F.lit(near.mean()).cast("double")).withColumn("score", R.hubness_adjusted(F.col("score"), F.col("r"), F.col("mean")))


@query("v12_hubness_kept", sql("vectors", _HUB + " SELECT id, round(r, 6) AS r FROM hub"))
def hubness_kept(spark, d):
    """The same after changes: the graph begins with vectors of which some are others' and some aren't in the table, and is put right."""
    v = vectors(spark, d).select(F.col("image_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    first = v.where("id % 7 <> 0").withColumn("vector", F.when(F.col("id") % 11 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    strange = v.where("id % 13 = 0").select((-1 - F.col("id")).alias("id"), "vector")
    kept = KeptNeighbours(spark, place(spark, "neighbours")).changed(first.union(strange))
    kept.changed(v.where("id % 7 = 0 or id % 11 = 0"), strange.select("id"))
    return kept.hubness().select("id", F.round("r", 6).alias("r"))


@query("j05_kept_neighbours", sql("vectors", _KNN.format(on="a.image_id <> b.image_id", k=10)))
def kept_neighbours(spark, d):
    """The neighbours that the kept graph of the table holds."""
    return graph(spark, d).neighbours().select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("v13_hubness_adjusted", sql("vectors", _ADJ + " SELECT id, round(score, 6) AS score FROM adj"))
def hubness_adjusted(spark, d):
    v = vectors(spark, d)
    lane = v.join(F.broadcast(v.where("image_id = 0").select(F.col("vector").alias("q")))).select(F.col("image_id").alias("id"), cosine("vector", "q").alias("score"))
    return adjusted(spark, d, lane).select("id", F.round("score", 6).alias("score"))


@query("v14_visual_only", sql("vectors", _ADJ + " SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM adj WHERE id IN (SELECT id FROM (SELECT image_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(vector, (SELECT vector FROM vectors WHERE image_id = 0)), 9) DESC, image_id) AS n FROM vectors) WHERE n <= 50) QUALIFY rank <= 10"))
def visual_only(spark, d):
    lane = dense_lane(spark, d).select("query_id", "id", "score")
    return R.ranked(adjusted(spark, d, lane).select("query_id", "id", "score"), 10).select("id", F.round("score", 6).alias("score"), "rank")


_OVERLAP = "len(list_intersect(list_distinct(regexp_extract_all(lower(left(text, 8000)), '[a-z0-9]+')), ['there', 'erent', 'with'])) / 3e0"


@query("v15_rerank", sql("vectors", _LANES + f", top AS (SELECT doc_id AS id, {_OVERLAP} AS score FROM documents WHERE doc_id IN (SELECT id FROM sparse WHERE rank <= 30)), tail AS (SELECT id, rank FROM sparse WHERE rank > 30) SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY tier, round(score, 9) DESC, id) AS rank FROM (SELECT id, 0 AS tier, score FROM top UNION ALL SELECT id, 1, -rank FROM tail)) WHERE rank <= 40"))
def rerank(spark, d):
    """The head of the lane scored again by the model hook, filled up from the tail in its old order."""
    from ..operators.models import overlap_score

    lane = sparse_lane(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    head = lane.where("rank <= 30").join(docs, "id").select("query_id", "id", overlap_score(F.lit(_QUERY), F.col("text")).alias("score"), F.lit(0).alias("tier"))
    tail = lane.where("rank > 30").select("query_id", "id", (-F.col("rank")).cast("double"), F.lit(1))
    return R.ranked(head.union(tail), 40, F.col("tier")).select("id", "rank")


@query("v16_greedy_dedupe")
def greedy_dedupe(spark, d):
    """Candidates of every hundredth id, near duplicates dropped in order of rank."""
    v = vectors(spark, d)
    near = knn(v, v.where("image_id % 100 = 0"), 60, "image_id")
    hashes = images(spark, d).select(F.col("image_id").alias("id"), "content_hash")
    pool = near.join(v.select(F.col("image_id").alias("id"), "vector"), "id").join(hashes, "id", "left").withColumn("tier", (F.col("rank") > 30).cast("int"))
    return R.greedy_dedupe(pool, 20, 0.3)


@query("v17_asset_boost", sql("images", ", s AS (SELECT image_id, (image_id % 17) / 20e0 AS score, asset_type IN ('Bar Chart', 'quarterly bar chart slide') AS hit FROM images) SELECT image_id, score, row_number() OVER (ORDER BY round(CASE WHEN hit THEN score * 1.1e0 ELSE score END, 9) DESC, image_id) AS rank FROM s"))
def asset_boost(spark, d):
    i = images(spark, d).withColumn("score", (F.col("image_id") % 17) / 20.0).withColumn("wanted", R.implied_type(F.lit("graphs")))
    order = F.round(R.boosted(F.col("score"), F.col("asset_type"), F.col("wanted")), 9)
    # one total order of all rows: a range sort, numbered by partition offsets
    return numbered(i.withColumn("o", -order), ["o", "image_id"], "rank").select("image_id", "score", "rank")


@query("v20_similar_search", sql("vectors", _LANES + ", f AS (SELECT id, sum(w / (60 + rank)) AS fused FROM (SELECT id, rank - 1 AS rank, 0.35e0 AS w FROM dense WHERE id <> 0 UNION ALL SELECT id, rank, 1.65e0 FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM sparse WHERE id <> 0)) GROUP BY id) SELECT id, round(least(1e0, fused / (2e0 / 61)), 6) AS score, row_number() OVER (ORDER BY round(least(1e0, fused / (2e0 / 61)), 9) DESC, id) AS rank FROM f QUALIFY rank <= 10"))
def similar_search(spark, d):
    """Near a reference image, which is left out of both lanes, weighted by the axis `subject`."""
    a, b = V.AXIS_WEIGHTS["subject"]
    lanes = [("dense", R.ranked(dense_lane(spark, d).where("id <> 0").drop("rank")), a), ("text", R.ranked(sparse_lane(spark, d).where("id <> 0").drop("rank")), b)]
    fused = R.rrf(lanes)
    return R.ranked(fused.withColumn("score", R.rrf_normalised(F.col("fused"), F.col("weight_sum"))), 10).select("id", F.round("score", 6).alias("score"), "rank")


@query("v21_axis_weights", sql("images", """SELECT image_id, axis, CASE axis WHEN 'balanced' THEN 1e0 WHEN 'subject' THEN 0.35e0 ELSE 1.65e0 END AS visual,
  CASE axis WHEN 'balanced' THEN 1e0 WHEN 'subject' THEN 1.65e0 ELSE 0.35e0 END AS text
FROM (SELECT image_id, (['balanced', 'subject', 'style', 'layout'])[image_id % 4 + 1] AS axis FROM images)"""))
def axis_weights(spark, d):
    """Every image's weights of the two lanes by the axis that it is compared on."""
    names = F.array(*map(F.lit, ("balanced", "subject", "style", "layout")))
    weights = F.create_map(*(x for k, (visual, text) in V.AXIS_WEIGHTS.items() for x in (F.lit(k), F.struct(F.lit(visual).alias("visual"), F.lit(text).alias("text")))))
    axis = images(spark, d).select("image_id", F.element_at(names, (F.col("image_id") % 4 + 1).cast("int")).alias("axis"))
    return axis.withColumn("w", weights[F.col("axis")]).select("image_id", "axis", "w.visual", "w.text")


@query("v22_facets", sql("images", "SELECT image_id, CASE image_id % 3 WHEN 0 THEN caption_short WHEN 1 THEN scene ELSE caption_detailed END AS semantic, CASE image_id % 3 WHEN 0 THEN list_slice(tags, 1, 3) ELSE [] END AS must_have FROM images"))
def facets(spark, d):
    """A stored caption as a query, by axis."""
    axis = F.element_at(F.array(F.lit("subject"), F.lit("style"), F.lit("layout")), (F.col("image_id") % 3 + 1).cast("int"))
    i = images(spark, d).withColumn("axis", axis)
    semantic = F.when(i.axis == "subject", i.caption_short).when(i.axis == "style", i.scene).otherwise(i.caption_detailed)
    return i.select("image_id", semantic.alias("semantic"), F.when(i.axis == "subject", F.slice("tags", 1, 3)).otherwise(F.array().cast("array<string>")).alias("must_have"))


@query("v23_text_leg_fallback", sql("vectors", _LANES + " SELECT id, rank FROM sparse WHERE rank <= 10"))
def text_leg_fallback(spark, d):
    """Where the scoring model fails the fused order stays."""
    from ..operators.models import with_fallback

    def broken():
        raise RuntimeError("no model")

    return with_fallback(broken, lambda: sparse_lane(spark, d, 10)).select("id", "rank")


@query("v24_clusters", sql("vectors", """, RECURSIVE_PART""").replace(", RECURSIVE_PART", """, e AS (SELECT a.image_id AS a, b.image_id AS b, list_cosine_similarity(a.vector, b.vector) AS s FROM vectors a JOIN vectors b ON a.image_id < b.image_id WHERE round(s, 9) >= 0.4),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a), c AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT component AS cluster_id, count(*) AS size, (SELECT round(max(s), 4) FROM e JOIN c x ON e.a = x.id WHERE x.component = c.component) AS max_similarity, list_sort(list(id)) AS ids FROM c GROUP BY component""").replace("WITH vectors", "WITH RECURSIVE vectors"))
def clusters_(spark, d):
    return clusters(similar_classes(vectors(spark, d), 0.4, "image_id"))


@query("j04_similar_pairs", sql("vectors", "SELECT a.image_id AS a, b.image_id AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS score FROM vectors a JOIN vectors b ON a.image_id < b.image_id WHERE round(list_cosine_similarity(a.vector, b.vector), 9) >= 0.35"))
def similar_pairs_(spark, d):
    return similar_pairs(vectors(spark, d), 0.35, "image_id").select("a", "b", F.round("score", 6).alias("score"))


@query("j03_knn", sql("vectors", _KNN.format(on="a.image_id % 100 = 0", k=10)))
def knn_(spark, d):
    v = vectors(spark, d)
    return knn(v, v.where("image_id % 100 = 0"), 10, "image_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("j05_knn_self_join", sql("vectors", _KNN.format(on="a.image_id <> b.image_id", k=5)))
def knn_self(spark, d):
    """The same by blocks that meet pairwise, as for more queries than may travel with tasks."""
    v = vectors(spark, d)
    return knn(v, v, 5, "image_id", exclude_self=True, carried=0).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("j01_results_with_records", sql("vectors images", f", s AS (SELECT image_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(vector, {_REF}), 9) DESC, image_id) AS rank FROM vectors) SELECT id, rank, source_file FROM s JOIN images ON image_id = id WHERE rank <= 50 AND NOT deleted"))
def results_with_records(spark, d):
    i = active(spark, d).select(F.col("image_id").alias("id"), "source_file")
    return dense_lane(spark, d).join(i, "id").select("id", "rank", "source_file")


@query("j02_lane_union", sql("vectors", _LANES + " SELECT coalesce(dense.id, sparse.id) AS id, round(coalesce(dense.score, 0), 6) AS dense_score, round(coalesce(sparse.score, 0), 6) AS sparse_score FROM dense FULL JOIN sparse ON dense.id = sparse.id"))
def lane_union(spark, d):
    f = R.rrf([("dense", dense_lane(spark, d), 1.0), ("sparse", sparse_lane(spark, d), 1.0)])
    return f.select("id", F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"))


@query("w01_rank_in_lane", "SELECT conv_id AS query_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations")
def rank_in_lane(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.length("text").cast("double").alias("score"))
    return R.ranked(c).select("query_id", "id", "rank")


@query("w02_result_rank", sql("vectors images", ", c AS (SELECT v.image_id AS id, list_cosine_similarity(v.vector, r.vector) AS score FROM vectors v, vectors r WHERE r.image_id = 0), s AS (SELECT id FROM c ORDER BY round(score, 9) DESC, id LIMIT 50) SELECT id, row_number() OVER (ORDER BY created_at, id) AS rank FROM s JOIN images ON image_id = id"))
def result_rank(spark, d):
    j = dense_lane(spark, d).drop("rank").join(images(spark, d).select(F.col("image_id").alias("id"), "created_at"), "id")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*R.sort_keys("oldest")))).select("id", "rank")


_NAME = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
for _key, _order in {"newest": "created_at DESC, id DESC", "oldest": "created_at, id", "name": f"lower({_NAME.format('name')}), id", "source": "lower(regexp_extract(source_file, '[^/]+$')), id"}.items():

    def _sorted(spark, d, key=_key):
        """All rows as one result list: a range sort, numbered by the sizes of the ranges before."""
        i = images(spark, d).select(F.col("image_id").alias("id"), F.unix_micros("created_at").alias("at"), T.strip(T.text_or_empty("caption_short")).alias("name"), T.basename("source_file").alias("file"))
        first = {"newest": -F.col("at"), "oldest": F.col("at"), "name": F.lower("name"), "source": F.lower("file")}[key]
        return numbered(i.select("id", first.alias("first"), (-F.col("id") if key == "newest" else F.col("id")).alias("second")), ["first", "second"], "rank").select("id", "rank")

    query(f"o02_result_sort_{_key}", sql("images", f", r AS (SELECT image_id AS id, created_at, coalesce(caption_short, '') AS name, source_file FROM images) SELECT id, row_number() OVER (ORDER BY {_order}) AS rank FROM r"))(_sorted)


def _lab_pool(spark, d):
    return pool(dense_lane(spark, d), dense_lane(spark, d, 50, 9), sparse_lane(spark, d), active(spark, d))


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))


for _name, _select in lab_sql(_OVERLAP).items():
    query(f"v29_lab_{_name}", sql("vectors images", _THREE + _select))(lambda spark, d, name=_name: compared(_lab_pool(spark, d), name, _QUERY, _documents(spark, d)))


def _queries(spark, d):
    """Every hundredth image as a query: its vector, the vector nine ids on as a caption's, its short caption as words."""
    v = vectors(spark, d)
    later = v.select((F.col("image_id") - 9).alias("image_id"), F.col("vector").alias("caption_vector"))
    i = images(spark, d).select("image_id", F.col("caption_short").alias("text"))
    asked = v.where("image_id % 100 = 0").join(later, "image_id").join(i, "image_id")
    return asked.select(F.col("image_id").alias("query_id"), "vector", "caption_vector", "text")


#: The lanes of all these queries, and the pool of each, as SQL.
_MANY = _LANES.split(", docs AS", 1)[0] + ", docs AS" + _LANES.split(", docs AS", 1)[1].split(",\nbm AS", 1)[0] + """,
asked AS (
  SELECT q.image_id AS query_id, q.vector, c.vector AS caption_vector, i.caption_short AS text
  FROM vectors q JOIN vectors c ON c.image_id = q.image_id + 9 JOIN images i ON i.image_id = q.image_id WHERE q.image_id % 100 = 0),
dense AS (
  SELECT query_id, image_id AS id, list_cosine_similarity(asked.vector, v.vector) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(asked.vector, v.vector), 9) DESC, image_id) AS rank
  FROM asked, vectors v QUALIFY rank <= 50),
caption AS (
  SELECT query_id, image_id AS id, list_cosine_similarity(asked.caption_vector, v.vector) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(asked.caption_vector, v.vector), 9) DESC, image_id) AS rank
  FROM asked, vectors v QUALIFY rank <= 50),
words AS (
  SELECT query_id, term, count(*) AS times
  FROM (SELECT query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM asked) GROUP BY ALL),
bm AS (
  SELECT query_id, id, sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
  FROM post JOIN idf USING (term) JOIN words USING (term), size GROUP BY query_id, id HAVING score > 0),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 50),
hits AS (
  SELECT query_id, id, 'd' AS lane, score, rank FROM dense
  UNION ALL SELECT query_id, id, 't', score, rank FROM caption UNION ALL SELECT query_id, id, 's', score, rank FROM sparse),
pool AS (
  SELECT query_id, id, coalesce(max(score) FILTER (lane = 'd'), 0e0) AS dense, coalesce(max(score) FILTER (lane = 't'), 0e0) AS text,
    coalesce(max(score) FILTER (lane = 's'), 0e0) AS sparse
  FROM hits WHERE id IN (SELECT image_id FROM images WHERE NOT deleted) GROUP BY query_id, id)"""
_MANY_OVERLAP = """len(list_intersect(list_distinct(regexp_extract_all(lower(left(documents.text, 8000)), '[a-z0-9]+')),
  list_distinct(regexp_extract_all(lower(asked.text), '[a-z0-9]+')))) / greatest(1e0, len(list_distinct(regexp_extract_all(lower(asked.text), '[a-z0-9]+'))))"""


def lanes(spark, d):
    """What the visual, the caption and the sparse lane find for each of the queries."""
    q, v = _queries(spark, d), vectors(spark, d)
    dense = knn(v, q.select(F.col("query_id").alias("image_id"), "vector"), V.DENSE_K, "image_id")
    caption = knn(v, q.select(F.col("query_id").alias("image_id"), F.col("caption_vector").alias("vector")), V.DENSE_K, "image_id")
    sparse = bm25(stored(spark, f"{d}/documents.parquet", "doc_id", "text"), q.select("query_id", "text"), V.SPARSE_K)
    return dense, caption, sparse


def _shown(hits):
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("v03_dense_lane_many", sql("vectors images", _MANY + " SELECT query_id, id, round(score, 6) AS score, rank FROM dense"))
def dense_many(spark, d):
    return _shown(lanes(spark, d)[0])


@query("v04_text_lane_many", sql("vectors images", _MANY + " SELECT query_id, id, round(score, 6) AS score, rank FROM caption"))
def caption_many(spark, d):
    return _shown(lanes(spark, d)[1])


@query("v07_bm25_many", sql("vectors images", _MANY + " SELECT query_id, id, round(score, 6) AS score, rank FROM sparse"))
def bm25_many(spark, d):
    return _shown(lanes(spark, d)[2])


@query(
    "v09_rrf_many",
    sql(
        "vectors images",
        _MANY
        + """ SELECT query_id, id, round(sum(CASE lane WHEN 'd' THEN 1e0 WHEN 't' THEN 1e0 ELSE 0.5e0 END / (60 + rank)), 9) AS fused,
  round(coalesce(max(score) FILTER (lane = 'd'), 0), 6) AS dense_score, round(coalesce(max(score) FILTER (lane = 't'), 0), 6) AS text_score,
  round(coalesce(max(score) FILTER (lane = 's'), 0), 6) AS sparse_score FROM hits GROUP BY query_id, id""",
    ),
)
def rrf_many(spark, d):
    f = R.rrf(list(zip(("dense", "text", "sparse"), lanes(spark, d), (1.0, 1.0, 0.5))))
    return f.select("query_id", "id", F.round("fused", 9).alias("fused"), *(F.round(f"{c}_score", 6).alias(f"{c}_score") for c in ("dense", "text", "sparse")))


@query(
    "v10_rrf_normalised",
    sql(
        "vectors images",
        _MANY
        + """, f AS (SELECT query_id, id, sum(CASE lane WHEN 'd' THEN 1e0 WHEN 't' THEN 0.35e0 ELSE 0e0 END / (60 + rank)) AS f FROM hits GROUP BY query_id, id)
SELECT query_id, id, CASE WHEN f <= 0 THEN 0e0 ELSE round(least(1e0, f / (1.35e0 / 61)), 9) END AS score FROM f""",
    ),
)
def rrf_normalised(spark, d):
    """The share of the best that the lanes could give; what a lane without weight found has none."""
    f = R.rrf(list(zip(("dense", "text", "sparse"), lanes(spark, d), (1.0, 0.35, 0.0))))
    return f.select("query_id", "id", F.round(R.rrf_normalised(F.col("fused"), F.col("weight_sum")), 9).alias("score"))


@query("v29_lab_comparison", sql("vectors images", _MANY + comparison_sql(_MANY_OVERLAP)))
def lab_comparison(spark, d):
    """All variants that rank one pool, for every query, in one plan."""
    found = pool(*lanes(spark, d), active(spark, d))
    return comparison(found, _queries(spark, d).select("query_id", "text"), _documents(spark, d))


@query(
    "j17_eval_modes_many",
    sql(
        "vectors images",
        _MANY
        + """, rel AS (SELECT query_id, v.image_id AS id FROM asked JOIN vectors q ON q.image_id = query_id JOIN vectors v ON v.label = q.label AND v.image_id <> query_id),
m AS (
  SELECT 'similar' AS mode, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dense WHERE id <> query_id
  UNION ALL SELECT 'text', query_id, id, rank FROM sparse
  UNION ALL SELECT 'retrieval', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, id)
    FROM (SELECT query_id, id, sum(1e0 / (60 + rank)) AS f FROM hits GROUP BY query_id, id)),
c AS (
  SELECT mode, rel.query_id, count(m.id) FILTER (rank <= 10) > 0 AS hit, count(m.id) FILTER (rank <= 10) / count(*) AS recall, coalesce(1e0 / min(rank), 0e0) AS mrr
  FROM rel CROSS JOIN (VALUES ('similar'), ('text'), ('retrieval')) x(mode) LEFT JOIN m USING (mode, query_id, id) GROUP BY ALL)
SELECT mode, count(*) AS cases, round(avg(CAST(hit AS INTEGER)), 6) AS hit_10, round(avg(recall), 6) AS recall_10, round(avg(mrr), 6) AS mrr_best FROM c GROUP BY mode""",
    ),
)
def eval_modes_many(spark, d):
    """Every query as a case with the images of its label as the right answers, by three ways of searching; a case that finds nothing counts."""
    dense, caption, sparse = lanes(spark, d)
    fused = R.rrf([("dense", dense, 1.0), ("text", caption, 1.0), ("sparse", sparse, 1.0)])
    ways = {
        "similar": R.ranked(dense.where("id <> query_id").select("query_id", "id", "score")),
        "text": sparse,
        "retrieval": R.ranked(fused.select("query_id", "id", F.col("fused").alias("score"))),
    }
    found = None
    for mode, hits in ways.items():
        one = hits.select(F.lit(mode).alias("mode"), F.col("query_id").alias("case"), "id", "rank")
        found = one if found is None else found.unionByName(one)
    v = vectors(spark, d).select("image_id", "label")
    q = _queries(spark, d).select(F.col("query_id").alias("case")).join(v.withColumnRenamed("image_id", "case"), "case")
    right = q.join(v, "label").where("image_id <> case").select("case", F.col("image_id").alias("id"))
    modes = spark.createDataFrame([(m,) for m in ways], "mode string")
    cases = right.join(F.broadcast(modes)).select(F.struct("mode", "case").alias("case_id"), "id", F.col("id").alias("pos"))
    metrics = A.case_metrics(found.select(F.struct("mode", "case").alias("case_id"), "id", "rank"), cases, (10,))
    mean = lambda c: F.round(F.avg(c), 6)
    return metrics.groupBy(F.col("case_id.mode").alias("mode")).agg(F.count("*").alias("cases"), mean(F.col("hit_10").cast("int")).alias("hit_10"), mean("recall_10").alias("recall_10"), mean("mrr_best").alias("mrr_best"))


def _searched(spark, d, filters=None, avoid=(), top_k=V.TOP_K, **how):
    v, i = vectors(spark, d), images(spark, d)
    found = candidates(_queries(spark, d), i, v, v, stored(spark, f"{d}/documents.parquet", "doc_id", "text"), filters, None, avoid)
    return results(found, i, v, top_k, **how)


@query("v29_lab_baseline")
def lab_baseline(spark, d):
    return _searched(spark, d, top_k=20)


@query("v29_lab_no_keyword_filters")
def lab_no_keyword_filters(spark, d):
    """The search again with its keywords cleared: what `v11_search_filtered` finds without the avoided terms."""
    return _searched(spark, d, Filters(file_types=["pptx", "pdf"]), top_k=20)


@query("v29_lab_visual_hubness")
def lab_visual_hubness(spark, d):
    """The pool by visual score less hubness, near duplicates dropped."""
    lane = adjusted(spark, d, _lab_pool(spark, d).select("query_id", "id", F.col("dense_score").alias("score")))
    hashes = images(spark, d).select(F.col("image_id").alias("id"), "content_hash")
    v = vectors(spark, d).select(F.col("image_id").alias("id"), "vector")
    order = R.ranked(lane.select("query_id", "id", "score")).join(hashes, "id")
    kept = R.greedy_dedupe(order.join(v, "id", "left").withColumn("tier", F.lit(0)), 20)
    return kept.join(order, ["query_id", "id"]).select(F.lit("visual_hubness").alias("variant"), "id", F.round("score", 6).alias("score"), F.col("kept_rank").alias("rank"))


@query("v11_search_unfiltered")
def search_unfiltered(spark, d):
    return _searched(spark, d)


@query("v11_search_filtered")
def search_filtered(spark, d):
    return _searched(spark, d, Filters(file_types=["pptx", "pdf"]), avoid=["with ", "erent"], min_percent=20, sort="newest")


@query("v11_search_relaxed")
def search_relaxed(spark, d):
    """Nothing reaches 100 %, so all stays and says so."""
    return _searched(spark, d, min_percent=100)


@query("v11_search_empty")
def search_empty(spark, d):
    return _searched(spark, d, Filters(authors=["nobody of that name"]))


for _axis in V.AXIS_WEIGHTS:

    @query(f"v20_similar_{_axis}")
    def similar_by_axis(spark, d, axis=_axis):
        v = vectors(spark, d)
        refs = _queries(spark, d).select("query_id", "vector", "text")
        return similar(refs, images(spark, d), v, stored(spark, f"{d}/documents.parquet", "doc_id", "text"), axis, min_percent=10)
