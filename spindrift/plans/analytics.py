"""Queries of aggregations, joins of events, windows and evaluation (A, J, W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as O
from ..operators.knn import knn
from .registry import query
from .scalar import _ASSET_SQL
from .views import active, images, interactions, searches, sql, table, vectors

_FLAGS = ", f AS (SELECT *, result_count = 0 AS zero, result_count > 0 AND coalesce(top_score < 0.25, false) AS weak, result_count > 0 AND id NOT IN (SELECT search_event_id FROM interactions) AS no_ix FROM searches)"
_DAILY = _FLAGS + """, days AS (SELECT dt, sum(s) AS searches, sum(z) AS zero, sum(w) AS weak, sum(r) AS with_results, sum(n) AS no_interaction, sum(i) AS interactions FROM (
  SELECT CAST(created_at AS DATE) AS dt, 1 AS s, CAST(zero AS INT) AS z, CAST(weak AS INT) AS w, CAST(result_count > 0 AS INT) AS r, CAST(no_ix AS INT) AS n, 0 AS i FROM f UNION ALL SELECT CAST(created_at AS DATE), 0, 0, 0, 0, 0, 1 FROM interactions) GROUP BY dt)"""


@query("a01_search_kpis", sql("searches interactions", _FLAGS + """, c AS (SELECT count(*) AS total_searches, count(*) FILTER (zero) AS zero_result_count, count(*) FILTER (weak) AS weak_result_count, count(*) FILTER (result_count > 0) AS searches_with_results, count(*) FILTER (no_ix) AS no_interaction_count, (SELECT count(*) FROM interactions) AS interaction_count FROM f)
SELECT *, round(interaction_count / searches_with_results, 4) AS interaction_rate, round(zero_result_count / total_searches, 4) AS zero_result_rate, round(weak_result_count / total_searches, 4) AS weak_result_rate, round(no_interaction_count / searches_with_results, 4) AS no_interaction_rate FROM c"""))
def kpis(spark, d):
    return O.kpis(searches(spark, d), interactions(spark, d))


@query("a02_daily_rollup", sql("searches interactions", _DAILY + " SELECT CAST(dt AS VARCHAR) AS dt, searches, zero, weak, with_results, no_interaction, interactions FROM days"))
def daily(spark, d):
    return O.daily(searches(spark, d), interactions(spark, d)).withColumn("dt", F.col("dt").cast("string"))


@query("a03_range_sum", sql("searches interactions", _DAILY + " SELECT sum(searches) AS searches, sum(zero) AS zero, sum(weak) AS weak, sum(with_results) AS with_results, sum(no_interaction) AS no_interaction, sum(interactions) AS interactions FROM days WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"))
def range_sum(spark, d):
    return O.range_sum(O.daily(searches(spark, d), interactions(spark, d)), "2024-01-05", "2024-01-12")


_TOPS = {"source": ("source", 8), "author": ("author", 5), "type": ("source_type", 99), "asset": ("lower(trim(asset_type))", 8)}
_TOP_SQL = " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, v AS value, n, row_number() OVER (ORDER BY n DESC, v) AS rank FROM (SELECT {e} AS v, count(*) AS n FROM images WHERE NOT deleted AND coalesce({e}, '') <> '' GROUP BY 1)) WHERE rank <= {m}" for k, (e, m) in _TOPS.items())
_TOP_SQL += " UNION ALL SELECT * FROM (SELECT 'tag' AS kind, v AS value, n, row_number() OVER (ORDER BY n DESC, v) AS rank FROM (SELECT lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS v, count(*) AS n FROM (SELECT unnest(tags) AS t FROM images WHERE NOT deleted) GROUP BY 1) WHERE v <> '') WHERE rank <= 12"


@query("a04_corpus_tops", sql("images", _TOP_SQL))
def corpus_tops(spark, d):
    i = active(spark, d)
    low = F.lower(T.strip("asset_type"))
    out = O.top(i, F.col("source"), 8, "source").union(O.top(i, F.col("author"), 5, "author")).union(O.top(i, F.col("source_type"), 99, "type")).union(O.top(i, low, 8, "asset"))
    return out.union(O.top(i.select(F.explode("tags").alias("t")), F.lower(T.strip("t")), 12, "tag"))


@query("a04_corpus_samples", sql("images", r", s AS (SELECT 'caption' AS kind, regexp_replace(caption_short, '^\s+|\s+$', '', 'g') AS value, image_id AS pos FROM images WHERE NOT deleted UNION ALL SELECT 'scene', regexp_replace(scene, '^\s+|\s+$', '', 'g'), image_id FROM images WHERE NOT deleted), f AS (SELECT kind, lower(value) AS k, arg_min(value, pos) AS value, min(pos) AS pos FROM s WHERE value <> '' GROUP BY 1, 2) SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY pos) AS rank FROM f QUALIFY rank <= CASE kind WHEN 'caption' THEN 12 ELSE 8 END"))
def corpus_samples(spark, d):
    i = active(spark, d)
    return O.samples(i, F.col("caption_short"), "image_id", 12, 200, "caption").union(O.samples(i, F.col("scene"), "image_id", 8, 120, "scene"))


@query("a04_corpus_counts", sql("images", "SELECT count(*) AS indexed, CAST(min(CAST(modified_at AS DATE)) AS VARCHAR) AS modified_after, CAST(max(CAST(modified_at AS DATE)) AS VARCHAR) AS modified_before FROM images WHERE NOT deleted"))
def corpus_counts(spark, d):
    day = F.to_date("modified_at")
    return active(spark, d).agg(F.count("*").alias("indexed"), F.min(day).cast("string").alias("modified_after"), F.max(day).cast("string").alias("modified_before"))


@query("a05_corpus_fingerprint", sql("images", """SELECT left(sha256('{"count":' || count(*) || ',"modified":"' || CAST(max(CAST(modified_at AS DATE)) AS VARCHAR) || '","sources":' || count(DISTINCT source) || '}'), 16) AS fingerprint FROM images WHERE NOT deleted"""))
def corpus_fingerprint(spark, d):
    s = active(spark, d).agg(F.count("*").alias("count"), F.max(F.to_date("modified_at")).cast("string").alias("modified"), F.countDistinct("source").alias("sources"))
    return s.select(T.digest(F.to_json(F.struct("count", "modified", "sources")), 16).alias("fingerprint"))


@query("a06_tag_vocabulary", sql("images", "SELECT DISTINCT lower(t) AS tag FROM (SELECT unnest(tags) AS t FROM images WHERE NOT deleted) WHERE regexp_matches(t, '^[a-zA-Z]{1,3}$')"))
def tag_vocabulary(spark, d):
    t = active(spark, d).select(F.explode("tags").alias("t")).where(F.col("t").rlike("^[a-zA-Z]{1,3}$"))
    return t.select(F.lower("t").alias("tag")).distinct()


@query("a06_prompt_vocabulary", sql("images", r", t AS (SELECT source, lower(t) AS tag FROM (SELECT source, unnest(tags) AS t FROM images WHERE NOT deleted) WHERE t <> ''), n AS (SELECT tag, count(*) AS n, count(*) FILTER (source = 'src1') AS own FROM t GROUP BY tag) SELECT tag, row_number() OVER (ORDER BY own DESC, n DESC, tag) AS rank FROM n QUALIFY rank <= 200"))
def prompt_vocabulary(spark, d):
    """At most 200 tags, those frequent in the same source first."""
    t = active(spark, d).select("source", F.explode(F.transform("tags", F.lower)).alias("tag")).where("tag <> ''")
    n = t.groupBy("tag").agg(F.count("*").alias("n"), F.sum((F.col("source") == "src1").cast("long")).alias("own"))
    order = [F.col("own").desc(), F.col("n").desc(), F.col("tag")]
    return n.orderBy(*order).limit(200).select("tag", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))


@query("a07_asset_distribution", sql("images", ", k AS (SELECT CASE WHEN trim(coalesce(asset_type, '')) = '' THEN 'unclassified' WHEN lower(trim(asset_type)) IN ('photo', 'diagram', 'chart', 'screenshot', 'logo', 'illustration', 'icon', 'table', 'map', 'other') THEN lower(trim(asset_type)) ELSE 'other' END AS asset_type FROM images), t AS (SELECT unnest(['photo', 'diagram', 'chart', 'screenshot', 'logo', 'illustration', 'icon', 'table', 'map', 'other', 'unclassified']) AS asset_type) SELECT t.asset_type, count(k.asset_type) AS n, round(100e0 * count(k.asset_type) / (SELECT count(*) FROM images), 2) AS percent FROM t LEFT JOIN k ON t.asset_type = k.asset_type GROUP BY t.asset_type"))
def asset_distribution(spark, d):
    return O.distribution(images(spark, d))


@query("a08_confusion_signals", sql("images", ", i AS (SELECT image_id, (['diagram', 'photo', 'illustration', 'chart'])[image_id % 4 + 1] AS kind, array_to_string(tags, ' ') || CASE WHEN image_id % 5 = 0 THEN ' bar logo browser flowchart' ELSE '' END AS t FROM images), h AS (SELECT 'chart_tag_vs_diagram' AS signal, image_id FROM i WHERE kind = 'diagram' AND regexp_matches(lower(t), 'chart|graph|bar') UNION ALL SELECT 'screenshot_tag_vs_photo', image_id FROM i WHERE kind = 'photo' AND regexp_matches(lower(t), 'screenshot|ui|browser') UNION ALL SELECT 'logo_tag_vs_illustration', image_id FROM i WHERE kind = 'illustration' AND regexp_matches(lower(t), 'logo|wordmark|brand') UNION ALL SELECT 'flowchart_caption_vs_chart', image_id FROM i WHERE kind = 'chart' AND regexp_matches(lower(t), 'flowchart|infographic|process diagram')) SELECT signal, count(*) AS n, list_slice(list_sort(list(image_id)), 1, 5) AS ids FROM h GROUP BY signal"))
def confusion_signals(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("diagram", "photo", "illustration", "chart"))), (F.col("image_id") % 4 + 1).cast("int"))
    tags = F.when(F.col("image_id") % 5 == 0, F.concat("tags", F.array(*map(F.lit, ("bar", "logo", "browser", "flowchart"))))).otherwise(F.col("tags"))
    i = images(spark, d).select("image_id", kind.alias("asset_type"), tags.alias("tags"), F.lit("").alias("caption_short"), F.lit("").alias("caption_detailed"))
    return O.confusion(i)


@query("a09_rescan_stats", sql("images", ", q AS (SELECT image_id, caption_quality AS before, CASE WHEN length(regexp_replace(caption_short, '^\\s+|\\s+$', '', 'g')) < 15 THEN 'weak' ELSE 'ok' END AS after FROM images) SELECT after AS quality, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM after) AS changed FROM q GROUP BY after"))
def rescan_stats(spark, d):
    """Captions judged again: counts by quality and how many changed."""
    after = F.when(F.length(T.strip("caption_short")) < 15, "weak").otherwise("ok")
    q = images(spark, d).select(after.alias("quality"), F.col("caption_quality").alias("before"))
    return q.groupBy("quality").agg(F.count("*").alias("n"), F.sum((~F.col("before").eqNullSafe(F.col("quality"))).cast("long")).alias("changed"))


@query("a10_ingest_stats", "SELECT user_id, count(*) AS batches, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS images, arg_max(event_id, event_id) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def ingest_stats(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("batches"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("images"), F.max_by(F.when(F.col("event_type") == "error", F.col("event_id")), F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"))


@query("a11_ingest_timing", "WITH s AS (SELECT event_type AS step, value AS sec FROM events UNION ALL SELECT 'total_' || (event_id % 3), value / 2 FROM events) SELECT step, count(*) AS n, round(sum(sec), 6) AS total, round(avg(sec), 6) AS mean, round(quantile_cont(sec, 0.5), 6) AS p50, round(quantile_cont(sec, 0.95), 6) AS p95, round(100 * sum(sec) / (SELECT sum(value) FROM events), 4) AS share FROM s GROUP BY step")
def ingest_timing(spark, d):
    e = table(spark, d, "events")
    steps = F.map_from_arrays(F.array(F.col("event_type"), F.concat(F.lit("total_"), (F.col("event_id") % 3).cast("string"))), F.array(F.col("value"), F.col("value") / 2))
    return O.step_times(e.select(steps.alias("steps"), F.col("value").alias("total_sec")))


@query("a12_query_timing", "WITH g AS (SELECT user_id AS id, event_type AS step, sum(value / 1000) AS s FROM events GROUP BY 1, 2) SELECT id, step, floor(s * 10000e0 + 0.500001e0) / 10e0 AS ms, round(100 * s / sum(s) OVER (PARTITION BY id), 4) AS share FROM g")
def query_timing(spark, d):
    e = table(spark, d, "events")
    return O.query_times(e.select(F.col("user_id").alias("id"), F.col("event_type").alias("step"), (F.col("value") / 1000).alias("seconds")))


_CASES = """, rel AS (SELECT q.image_id AS case_id, v.image_id AS id, row_number() OVER (PARTITION BY q.image_id ORDER BY v.image_id DESC) - 1 AS pos FROM vectors q JOIN vectors v ON q.label = v.label AND q.image_id <> v.image_id WHERE q.image_id % 100 = 0),
ranks AS (SELECT a.image_id AS case_id, b.image_id AS id, row_number() OVER (PARTITION BY a.image_id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 9) DESC, b.image_id) AS rank FROM vectors a JOIN vectors b ON a.image_id <> b.image_id WHERE a.image_id % 100 = 0 QUALIFY rank <= 10),
m AS (SELECT rel.case_id, count(DISTINCT rel.id) AS n_relevant, coalesce(1e0 / arg_min(rank, pos) FILTER (rank IS NOT NULL), 0e0) AS mrr, coalesce(1e0 / min(rank), 0e0) AS mrr_best,
  """ + ", ".join(f"count(*) FILTER (rank <= {k}) > 0 AS hit_{k}, count(*) FILTER (rank <= {k}) / count(*) AS recall_{k}" for k in (1, 3, 5, 10)) + " FROM rel LEFT JOIN ranks USING (case_id, id) GROUP BY rel.case_id)"


def _case_rows(spark, d):
    """(case_id, id, rank) and (case_id, id, pos): every hundredth image looked up among all, and those of its label."""
    v = vectors(spark, d)
    q = v.where("image_id % 100 = 0")
    ranked = knn(v, q, 10, "image_id", exclude_self=True).select(F.col("query_id").alias("case_id"), "id", "rank")
    relevant = q.select(F.col("image_id").alias("case_id"), "label").join(v.select(F.col("image_id").alias("id"), "label"), "label").where("id <> case_id")
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("id").desc())) - 1
    return ranked, relevant.select("case_id", "id", pos.alias("pos"))


def _cases(spark, d):
    return O.case_metrics(*_case_rows(spark, d))


@query("a13_case_metrics", sql("vectors", _CASES + " SELECT * FROM m"))
def case_metrics(spark, d):
    return _cases(spark, d)


@query("a14_macro_averages", sql("vectors", _CASES + " SELECT count(*) AS cases, round(avg(mrr), 6) AS mrr, " + ", ".join(f"round(avg(CAST(hit_{k} AS DOUBLE)), 6) AS hit_{k}, round(avg(recall_{k}), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + " FROM m"))
def macro(spark, d):
    return O.macro(_cases(spark, d))


@query("a15_source_groups", sql("images", "SELECT regexp_extract(source_file, '[^/]+$') AS name, count(*) AS n, list_sort(list(DISTINCT slide_index) FILTER (slide_index IS NOT NULL)) AS slides FROM images GROUP BY 1"))
def source_groups(spark, d):
    return images(spark, d).groupBy(T.basename("source_file").alias("name")).agg(F.count("*").alias("n"), F.when(F.count("slide_index") > 0, F.sort_array(F.collect_set("slide_index"))).alias("slides"))


@query("a18_manifest_totals", "SELECT conv_id AS job_id, count(*) AS files, sum(length(text)) AS bytes FROM conversations GROUP BY conv_id")
def manifest_totals(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg(F.count("*").alias("files"), F.sum(F.length("text").cast("long")).alias("bytes"))


@query("a19_served_ids", sql("searches", "SELECT DISTINCT unnest([k, k + 1, k * 2]) AS image_id FROM searches WHERE created_at >= (SELECT max(created_at) FROM searches) - INTERVAL 10 DAYS"))
def served_ids(spark, d):
    s = searches(spark, d)
    newest = s.agg(F.max("created_at").alias("_n"))
    recent = s.join(F.broadcast(newest)).where(F.col("created_at") >= F.col("_n") - F.expr("INTERVAL 10 DAYS"))
    return recent.select(F.explode(F.array(F.col("k"), F.col("k") + 1, F.col("k") * 2)).alias("image_id")).distinct()


@query("j06_no_interaction", sql("searches interactions", "SELECT id FROM searches WHERE result_count > 0 AND id NOT IN (SELECT search_event_id FROM interactions)"))
def no_interaction(spark, d):
    return searches(spark, d).where("result_count > 0").join(interactions(spark, d).select(F.col("search_event_id").alias("id")), "id", "left_anti").select("id")


@query("j07_funnel", sql("searches interactions", "SELECT s.id, list(i.id ORDER BY i.created_at, i.id) FILTER (i.id IS NOT NULL) AS items FROM searches s LEFT JOIN interactions i ON i.search_event_id = s.id AND i.created_at >= s.created_at - INTERVAL 1 DAY GROUP BY s.id"))
def funnel(spark, d):
    f = O.funnel(searches(spark, d), interactions(spark, d))
    return f.select("id", F.when(F.size("items") > 0, F.transform("items", lambda x: x["id"])).alias("items"))


@query("j08_never_served", sql("images searches interactions", "SELECT image_id, image_id IN (SELECT image_id FROM interactions) AS interacted FROM images WHERE NOT deleted AND image_id NOT IN (SELECT k FROM searches)"))
def never_served(spark, d):
    i = active(spark, d).join(searches(spark, d).select(F.col("k").alias("image_id")), "image_id", "left_anti").select("image_id")
    hit = interactions(spark, d).select("image_id").distinct().withColumn("hit", F.lit(True))
    return i.join(hit, "image_id", "left").select("image_id", F.coalesce("hit", F.lit(False)).alias("interacted"))


@query(
    "j12_batch_queries",
    sql(
        "vectors",
        """, size AS (SELECT count(*) AS n FROM vectors),
q AS (SELECT conv_id, turn, (conv_id * 7 + turn) % n AS ref FROM conversations, size WHERE role = 'user'),
n AS (
  SELECT a.image_id AS ref, b.image_id AS id,
    row_number() OVER (PARTITION BY a.image_id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 9) DESC, b.image_id) AS rank
  FROM vectors a JOIN vectors b ON a.image_id <> b.image_id WHERE a.image_id IN (SELECT ref FROM q) QUALIFY rank <= 3)
SELECT conv_id, turn, id, rank FROM q JOIN n USING (ref)""",
    ),
)
def batch_queries(spark, d):
    """Many queries against the corpus at once: equal ones are searched once and joined back. Their number grows with both tables."""
    v = vectors(spark, d)
    n = v.agg(F.count("*").alias("n"))
    q = table(spark, d, "conversations").where("role = 'user'").join(F.broadcast(n)).select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn")) % F.col("n")).alias("query_id"))
    found = knn(v, v.join(q.select(F.col("query_id").alias("image_id")).distinct(), "image_id", "left_semi"), 3, "image_id", exclude_self=True)
    return q.join(found, "query_id").select("conv_id", "turn", "id", "rank")


@query("j14_relevance_join", sql("vectors", _CASES + " SELECT rel.case_id, rel.id, pos, rank FROM rel LEFT JOIN ranks USING (case_id, id)"))
def relevance_join(spark, d):
    v = vectors(spark, d)
    q = v.where("image_id % 100 = 0")
    ranked = knn(v, q, 10, "image_id", exclude_self=True).select(F.col("query_id").alias("case_id"), "id", "rank")
    rel = q.select(F.col("image_id").alias("case_id"), "label").join(v.select(F.col("image_id").alias("id"), "label"), "label").where("id <> case_id")
    placed = rel.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("id").desc())) - 1)
    return placed.join(ranked, ["case_id", "id"], "left").select("case_id", "id", "pos", "rank")


@query("w03_newest_by_category", sql("searches interactions", _FLAGS + ", c AS (SELECT 'recent' AS category, * FROM f UNION ALL SELECT 'zero_result', * FROM f WHERE zero UNION ALL SELECT 'weak_result', * FROM f WHERE weak UNION ALL SELECT 'no_interaction', * FROM f WHERE no_ix) SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id DESC) AS rank FROM c QUALIFY rank <= 50"))
def newest_by_category(spark, d):
    return O.quality_lists(searches(spark, d), interactions(spark, d), 50)


@query("w04_last_write_wins", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("l")).select("user_id", "l.*")


@query("w05_first_seen", sql("images", ", t AS (SELECT image_id, unnest(list_concat(tags, aliases)) AS t, generate_subscripts(list_concat(tags, aliases), 1) AS p FROM images), f AS (SELECT image_id, lower(t) AS k, arg_min(t, p) AS t, min(p) AS p FROM t GROUP BY 1, 2) SELECT image_id, list(t ORDER BY p) AS items FROM f GROUP BY image_id"))
def first_seen(spark, d):
    return images(spark, d).select("image_id", T.first_seen(F.concat("tags", "aliases")).alias("items"))


@query("w06_history_window", "WITH r AS (SELECT conv_id, turn, role || ': ' || left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM r WHERE n <= 6 GROUP BY conv_id")
def history_window(spark, d):
    line = F.concat("role", F.lit(": "), F.left(T.strip("text"), F.lit(200)))
    c = table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())).alias("n")).where("n <= 6")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("history"))


@query("w07_previous_results", sql("searches", ", r AS (SELECT id, user_id, created_at, list_transform(generate_series(1, result_count), lambda x: k + x) AS results FROM searches) SELECT id, coalesce(lag(list_slice(results, 1, 5)) OVER (PARTITION BY user_id ORDER BY created_at, id), []) AS previous FROM r"))
def previous_results(spark, d):
    """The first five results of the search before, as context of the next."""
    served = F.when(F.col("result_count") > 0, F.transform(F.sequence(F.lit(1), F.col("result_count")), lambda x: F.col("k") + x)).otherwise(F.array().cast("array<bigint>"))
    s = searches(spark, d).select("id", "user_id", "created_at", F.slice(served, 1, 5).alias("first"))
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    return s.select("id", F.coalesce(F.lag("first").over(w), F.array().cast("array<bigint>")).alias("previous"))


@query("j15_query_vocabulary", sql("images", _ASSET_SQL + ", v AS (SELECT DISTINCT lower(t) AS t FROM (SELECT unnest(tags) AS t FROM images WHERE NOT deleted)) SELECT conv_id, turn, w AS word FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE role = 'user') WHERE w IN (FROM v)"))
def query_vocabulary(spark, d):
    v = active(spark, d).select(F.explode(F.transform("tags", F.lower)).alias("word")).distinct()
    w = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(T.tokens("text"))).alias("word"))
    return w.join(v, "word", "left_semi").select("conv_id", "turn", "word")
