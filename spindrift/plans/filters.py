"""Queries of filters and projections (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import filters as O
from .registry import query
from .scalar import _ASSET_SQL, _PROVENANCE
from .spec import sanitised
from .views import active, images, interactions, searches, sql, table, vectors

_FILTER = O.Filters(file_types=["PPTX", "image"], asset_types=["chart", "diagram"], filename_contains=["SRC1", "src3"], authors=["author 1", "AUTHOR 3"], after="2023-12-30", before="2024-01-15")


@query("p01_metadata_filter", sql("images", _ASSET_SQL + " SELECT image_id FROM images JOIN typed USING (image_id) WHERE NOT deleted AND source_type IN ('pptx', 'image') AND canonical IN ('chart', 'diagram') AND trim(coalesce(images.asset_type, '')) <> '' AND (source_file LIKE '%/%src1%' OR source_file LIKE '%/%src3%') AND author IN ('Author 1', 'Author 3') AND modified_at >= TIMESTAMP '2023-12-30' AND modified_at <= TIMESTAMP '2024-01-15'"))
def metadata_filter(spark, d):
    return O.metadata_filter(active(spark, d), _FILTER).select("image_id")


@query("p02_filter_resolution", sql("images", "SELECT 'restricted' AS kind, count(*) AS n FROM images WHERE source_type = 'pdf' AND image_id IN (1, 2, 4, 7, 100) UNION ALL SELECT 'unfiltered', count(*) FROM images"))
def filter_resolution(spark, d):
    i = images(spark, d)
    some = O.allowed(i, O.Filters(file_types=["pdf"]), [1, 2, 4, 7, 100])
    none = O.allowed(i, O.Filters(), [])
    return some.agg(F.lit("restricted").alias("kind"), F.count("*").alias("n")).union((i if none is None else none).agg(F.lit("unfiltered"), F.count("*")))


@query("p03_active_guard", sql("images vectors", ", s AS (SELECT v.image_id, list_cosine_similarity(v.vector, (SELECT vector FROM vectors WHERE image_id = 0)) AS score FROM vectors v), a AS (SELECT image_id FROM images WHERE NOT deleted), pre AS (SELECT image_id FROM s WHERE image_id IN (FROM a) ORDER BY round(score, 9) DESC, image_id LIMIT 20), post AS (SELECT image_id FROM s ORDER BY round(score, 9) DESC, image_id LIMIT 20) SELECT 'before' AS guard, image_id FROM pre UNION ALL SELECT 'after', image_id FROM post WHERE image_id IN (FROM a)"))
def active_guard(spark, d):
    """Inactive rows go before the top k, or after it, when fewer may be left."""
    from ..operators.knn import knn

    v = vectors(spark, d)
    a = active(spark, d).select("image_id")
    q = v.where("image_id = 0")
    before = knn(v.join(a, "image_id", "left_semi"), q, 20, "image_id").select(F.lit("before").alias("guard"), F.col("id").alias("image_id"))
    after = knn(v, q, 20, "image_id").select(F.lit("after").alias("guard"), F.col("id").alias("image_id")).join(a, "image_id", "left_semi")
    return before.unionByName(after)


@query("p04_must_avoid", sql("images", "SELECT image_id FROM images WHERE NOT regexp_matches(lower(caption_short || ' ' || caption_detailed || ' ' || scene || ' ' || source_file || ' ' || array_to_string(tags, ' ')), 'reerth|src7|qu')"))
def must_avoid(spark, d):
    return O.avoids(images(spark, d), ["REERTH", "src7", "qu", " "]).select("image_id")


_MATCH = "least(100, greatest(0, CAST(round_even(least(1e0, greatest(0e0, top_score)) * 100e0, 0) AS INTEGER)))"


@query("p05_min_match_relaxed", sql("searches", f", m AS (SELECT user_id AS query_id, id, {_MATCH} AS match_percent FROM searches), s AS (SELECT *, bool_or(match_percent >= 97) OVER (PARTITION BY query_id) AS found FROM m) SELECT query_id, id, NOT found AS relaxed FROM s WHERE match_percent >= 97 OR NOT found"))
def min_match_relaxed(spark, d):
    from ..operators.retrieval import min_match

    s = searches(spark, d).select(F.col("user_id").alias("query_id"), "id", T.match_percent(F.col("top_score"), F.lit("fusion")).alias("match_percent"))
    return min_match(s, 97).select("query_id", "id", "relaxed")


@query("p06_min_match", sql("searches", f"SELECT user_id AS query_id, id FROM searches WHERE {_MATCH} >= 80"))
def min_match_plain(spark, d):
    from ..operators.retrieval import min_match

    s = searches(spark, d).select(F.col("user_id").alias("query_id"), "id", T.match_percent(F.col("top_score"), F.lit("fusion")).alias("match_percent"))
    return min_match(s, 80, relax=False).select("query_id", "id")


@query("p07_min_match_tiers", sql("searches", f"SELECT user_id AS query_id, id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN {_MATCH} >= 60 THEN 0 ELSE 1 END, round(top_score, 9) DESC, id) AS rank FROM searches"))
def min_match_tiers(spark, d):
    """Rows above the threshold first, those below as a pool behind them."""
    from ..operators.retrieval import ranked

    s = searches(spark, d).select(F.col("user_id").alias("query_id"), "id", F.col("top_score").alias("score"))
    tier = F.when(T.match_percent(F.col("score"), F.lit("fusion")) >= 60, 0).otherwise(1)
    return ranked(s, None, tier).select("query_id", "id", "rank")


@query("p08_search_flags", sql("searches interactions", "SELECT id, result_count = 0 AS zero, result_count > 0 AND coalesce(top_score < 0.25, false) AS weak, result_count > 0 AND id NOT IN (SELECT search_event_id FROM interactions) AS no_interaction FROM searches"))
def search_flags(spark, d):
    hit = interactions(spark, d).select(F.col("search_event_id").alias("id"))
    return O.search_flags(searches(spark, d), hit).select("id", "zero", "weak", "no_interaction")


@query(
    "p09_sanitised_spec",
    sql(
        "images vectors",
        """, live AS (SELECT * FROM images WHERE NOT deleted),
rate AS (SELECT coalesce(1e0 - avg(CASE WHEN coalesce(asset_type, '') <> '' THEN 1e0 ELSE 0e0 END), 1e0) AS r FROM live),
types AS (SELECT DISTINCT source_type AS t FROM live WHERE image_id IN (SELECT image_id FROM vectors)),
s AS (
  SELECT image_id AS id, image_id % 4 AS form, CASE WHEN image_id % 3 = 0 THEN source_type ELSE 'docx' END AS kind,
    image_id % 4 = 1 AND (SELECT r < 0.5e0 FROM rate) AS asset_stays FROM images),
k AS (SELECT *, form IN (1, 3) AND kind IN (FROM types) AS file_stays FROM s)
SELECT id, CASE WHEN form < 2 AND asset_stays THEN ['chart'] ELSE []::VARCHAR[] END AS asset_types,
  CASE WHEN form <> 2 AND file_stays THEN [kind] ELSE []::VARCHAR[] END AS file_types,
  CAST(form < 2 AND NOT asset_stays AS INTEGER) + CAST(form <> 2 AND NOT file_stays AS INTEGER) AS n_notes FROM k""",
    ),
)
def sanitised_spec(spark, d):
    """A parsed query for every image: what it asks for by its words, and whether the corpus can answer."""
    i = F.col("image_id")
    texts = F.array(*map(F.lit, ("diagram of a pipeline", "only charts in PDF files", "anything", "powerpoint slides")))
    none = F.array().cast("array<string>")
    kind = F.when(i % 3 == 0, F.col("source_type")).otherwise("docx")
    specs = images(spark, d).select(i.alias("id"), F.element_at(texts, (i % 4 + 1).cast("int")).alias("raw_text"), F.when(i % 4 < 2, F.array(F.lit("chart"))).otherwise(none).alias("asset_types"), F.when(i % 4 != 2, F.array(kind)).otherwise(none).alias("file_types"))
    live = active(spark, d)
    covered = live.join(vectors(spark, d).select("image_id"), "image_id", "left_semi")
    return sanitised(specs, live, covered).select("id", "asset_types", "file_types", F.size("notes").alias("n_notes"))


@query("p10_unclassified_rate", sql("images", "SELECT coalesce(1e0 - avg(CASE WHEN coalesce(asset_type, '') <> '' THEN 1e0 ELSE 0e0 END), 1e0) AS rate FROM images WHERE NOT deleted"))
def unclassified_rate(spark, d):
    return O.unclassified_rate(active(spark, d))


@query("p11_coverage", sql("images vectors", "SELECT source_type, count(*) > 0 AS covered FROM images WHERE NOT deleted AND image_id IN (SELECT image_id FROM vectors) GROUP BY source_type"))
def coverage(spark, d):
    i = active(spark, d).join(vectors(spark, d).select("image_id"), "image_id", "left_semi")
    return i.groupBy("source_type").agg((F.count("*") > 0).alias("covered"))


@query("p12_quality_filter", sql("images", "SELECT image_id, 'ok' AS asked FROM images WHERE coalesce(caption_quality, 'ok') = 'ok' UNION ALL SELECT image_id, 'weak' FROM images WHERE caption_quality = 'weak'"))
def quality_filter(spark, d):
    i = images(spark, d)
    return O.quality_filter(i, "ok").select("image_id", F.lit("ok").alias("asked")).union(O.quality_filter(i, "weak").select("image_id", F.lit("weak")))


@query("p13_case_selection", "SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) <= 30 AS short FROM benchmark WHERE item_id % 5 <> 0")
def case_selection(spark, d):
    """Evaluation cases without templates; which of them are short queries."""
    cases = table(spark, d, "benchmark").withColumn("template", F.col("item_id") % 5 == 0)
    return cases.where("not template").select("item_id", (F.size(T.tokens("text")) <= 30).alias("short"))


@query("p14_reference_excluded", sql("vectors", ", s AS (SELECT v.image_id, list_cosine_similarity(v.vector, r.vector) AS score FROM vectors v, vectors r WHERE r.image_id = 3 AND v.image_id <> 3) SELECT image_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, image_id LIMIT 15"))
def reference_excluded(spark, d):
    from ..operators.knn import knn

    v = vectors(spark, d)
    return knn(v, v.where("image_id = 3"), 15, "image_id", exclude_self=True).select(F.col("id").alias("image_id"), F.round("score", 6).alias("score"))


@query("p15_keywords_cleared", "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'user'")
def keywords_cleared(spark, d):
    """The same query with its keywords taken out."""
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.query_text(F.col("text"), F.lit(""), F.array().cast("array<string>")).alias("text"))


@query("p16_cards", sql("images", f"SELECT image_id, regexp_extract(source_file, '[^/]+$') AS source_name, '/images/' || image_id AS url, {_PROVENANCE} AS provenance, coalesce(caption_quality, 'ok') AS quality, coalesce(caption_quality, 'ok') = 'weak' AS weak FROM images"))
def cards(spark, d):
    i = images(spark, d)
    line = T.provenance(i.source_type, i.slide_index, i.page_index, i.source_file, i.modified_at, i.author)
    quality = F.coalesce("caption_quality", F.lit("ok"))
    return i.select("image_id", T.basename("source_file").alias("source_name"), F.concat(F.lit("/images/"), i.image_id.cast("string")).alias("url"), line.alias("provenance"), quality.alias("quality"), (quality == "weak").alias("weak"))


@query("p17_caption_predicates", sql("images", "SELECT image_id, 'weak' AS problem FROM images WHERE caption_quality = 'weak' UNION SELECT image_id, 'untyped' FROM images WHERE trim(coalesce(asset_type, '')) = ''"))
def caption_predicates(spark, d):
    i = images(spark, d)
    weak = i.where(F.col("caption_quality") == "weak").select("image_id", F.lit("weak").alias("problem"))
    return weak.union(i.where(T.blank("asset_type")).select("image_id", F.lit("untyped"))).distinct()


@query("p18_age_guard", "SELECT event_id, coalesce(m > (SELECT max(ts) FROM events) - INTERVAL 48 HOURS, false) AS too_new FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS m FROM events)")
def age_guard(spark, d):
    e = table(spark, d, "events").withColumn("last_modified", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")))
    now = e.agg(F.max(F.col("ts").cast("timestamp")).alias("_now"))
    return O.too_new(e.join(F.broadcast(now)), F.col("_now"), 48).select("event_id", "too_new")


@query("p19_recoverability", sql("images", ", b AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 2 = 0), s AS (SELECT DISTINCT source_file FROM images WHERE length(source) = 5) SELECT image_id, CASE WHEN image_id IN (FROM b) THEN 'display' WHEN source_type = 'image' AND source_file IN (FROM s) THEN 'source' ELSE 'unrecoverable' END AS recoverable FROM images"))
def recoverability(spark, d):
    i = images(spark, d)
    blobs = i.where("image_id % 3 <> 2 and image_id % 2 = 0")
    return O.recoverability(i, blobs, i.where(F.length("source") == 5)).select("image_id", "recoverable")


_STATUS = "(['queued', 'running', 'succeeded', 'failed', 'staging'])[conv_id % 5 + 1]"


@query("p20_busy_jobs", f"SELECT conv_id AS job_id, 'staging/' || conv_id || '/' || turn AS uri FROM conversations WHERE {_STATUS} IN ('staging', 'queued', 'running', 'cancel_requested')")
def busy_jobs(spark, d):
    """Staged files that running jobs still need: manifests of busy jobs, exploded."""
    c = table(spark, d, "conversations")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed", "staging"))), (F.col("conv_id") % 5 + 1).cast("int"))
    uri = F.concat(F.lit("staging/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    jobs = c.groupBy(F.col("conv_id").alias("job_id"), status.alias("status")).agg(F.collect_list(uri).alias("manifest"))
    return jobs.where(F.col("status").isin(*V.BUSY)).select("job_id", F.explode("manifest").alias("uri"))


@query("p21_deleted", sql("images", "SELECT image_id, source_file FROM images WHERE deleted"))
def deleted(spark, d):
    return images(spark, d).where("deleted").select("image_id", "source_file")
