"""Queries of suggestions, replies and reports (R), over corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import analytics as O
from ..operators import replies as P
from ..operators import suggestions as S
from .analytics import _CASES, _case_rows, _cases
from .registry import query
from .views import active, images, sql, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_POOL = (
    ", act AS (SELECT * FROM images WHERE NOT deleted), seeds AS (SELECT 0 AS tier, image_id * 10 + p AS pos, t AS text FROM (SELECT image_id, unnest(cases) AS t, generate_subscripts(cases, 1) AS p FROM act)"
    " UNION ALL SELECT 1, image_id, CASE WHEN length(s) <= 60 THEN s ELSE left(s, 57) || '...' END FROM (SELECT image_id, " + _STRIP.format("caption_short") + " AS s FROM act)"
    " UNION ALL SELECT 2, image_id, source FROM act),"
    " clean AS (SELECT tier, pos, " + _STRIP.format("text") + r" AS text FROM seeds), ok AS (SELECT * FROM clean WHERE text <> '' AND NOT regexp_matches(text, '(?i)^(?:images?|slides?|photos?|pictures?|content|visuals?|graphics?)\s+from\s+')),"
    " f AS (SELECT lower(text) AS k, arg_min(text, (tier, pos)) AS text, min((tier, pos)) AS o FROM ok GROUP BY 1), pool AS (SELECT text, row_number() OVER (ORDER BY o) AS rank FROM f)"
)


def _seeds(spark, d):
    i = active(spark, d)
    cases = i.select(F.lit(0).alias("tier"), "image_id", F.posexplode("cases").alias("p", "text")).select("tier", (F.col("image_id") * 10 + F.col("p") + 1).alias("pos"), "text")
    s = T.strip("caption_short")
    captions = i.select(F.lit(1).alias("tier"), F.col("image_id").alias("pos"), F.when(F.length(s) <= 60, s).otherwise(F.concat(F.left(s, F.lit(57)), F.lit("..."))).alias("text"))
    return cases.union(captions).union(i.select(F.lit(2), F.col("image_id"), "source"))


@query("r01_suggestion_pool", sql("images", _POOL + " SELECT text, rank FROM pool"))
def pool(spark, d):
    return S.pool(_seeds(spark, d))


@query("r02_blended_suggestions", sql("images", _POOL + ", c AS (SELECT * FROM (VALUES (-2, 'Blue charts'), (-1, 'blue CHARTS')) v(o, text)), b AS (SELECT text, o FROM c UNION ALL SELECT text, rank FROM pool), u AS (SELECT lower(text) AS k, arg_min(text, o) AS text, min(o) AS o FROM b GROUP BY 1) SELECT text, row_number() OVER (ORDER BY o) AS rank FROM u QUALIFY rank <= 6"))
def blended(spark, d):
    given = spark.createDataFrame([(-1, -2, "Blue charts"), (-1, -1, "blue CHARTS"), (-1, 0, "Images from deck.pptx")], "tier int, pos long, text string")
    return S.pool(given.union(_seeds(spark, d)), 6)


_FOLLOW = _POOL + """, r AS (SELECT source AS q, cases, tags, """ + _STRIP.format("coalesce(caption_short, '')") + """ AS cap, row_number() OVER (PARTITION BY source ORDER BY image_id) AS rank FROM act QUALIFY rank <= 5),
own AS (SELECT q, rank, list_concat(cases, list_transform(tags, lambda t: t || ' and related visuals'), CASE WHEN cap <> '' THEN [CASE WHEN length(cap) <= 60 THEN cap ELSE left(cap, 57) || '...' END] ELSE [] END) AS l FROM r),
sp AS (SELECT DISTINCT source AS q, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS n FROM act),
au AS (SELECT author FROM act WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, min(image_id) LIMIT 1),
ev AS (SELECT q, 0 AS tier, rank * 1000 + p - 1 AS pos, t FROM (SELECT q, rank, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM own)
  UNION ALL SELECT q, 1, 0, 'only charts and diagrams' FROM sp WHERE n % 2 = 0
  UNION ALL SELECT q, 1, 1, 'by ' || author FROM sp, au WHERE n % 3 <> 0
  UNION ALL SELECT q, 1, 2, CASE WHEN n % 5 = 0 THEN 'broaden the search' ELSE 'more like Images of ' || q END FROM sp
  UNION ALL SELECT q, 2, rank, text FROM sp, pool),
cl AS (SELECT q, tier, pos, """ + _STRIP.format("t") + """ AS t FROM ev),
fi AS (SELECT q, lower(t) AS k, min((tier, pos, t)) AS s FROM cl WHERE t <> '' AND NOT regexp_matches(t, '(?i)^(?:images?|slides?|photos?|pictures?|content|visuals?|graphics?)\\s+from\\s+') AND lower(t) NOT IN (lower(q), 'images of ' || lower(q)) GROUP BY 1, 2),
be AS (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY s) AS n FROM fi QUALIFY n <= 12)
SELECT q AS query_id, list(s[3] ORDER BY n) AS suggestions FROM be GROUP BY q"""


@query("r03_follow_ups", sql("images", _FOLLOW))
def follow_ups(spark, d):
    """Follow-ups of a search for each source: its first five images are the results. Twelve, so that all kinds are among them."""
    i = active(spark, d)
    page = i.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("image_id"))).where("rank <= 5").select(F.col("source").alias("query_id"), "rank", "cases", "tags", "caption_short")
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    listed = lambda on, x: F.when(on, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    specs = i.select("source").distinct().select(F.col("source").alias("query_id"), F.col("source").alias("text"), F.concat(F.lit("Images of "), "source").alias("semantic_query"), listed(n % 2 != 0, "chart").alias("asset_types"), listed(n % 3 == 0, "Ann").alias("authors"), (n % 5 == 0).alias("is_refinement"))
    top = i.where("author is not null").groupBy("author").agg(F.count("*").alias("n"), F.min("image_id").alias("first")).orderBy(F.col("n").desc(), "first").limit(1)
    return S.follow_ups(page, specs, top, S.pool(_seeds(spark, d)), 12)


#: Pages of results of all lengths up to twelve: the first images of each source; a location is a slide or a page.
_PAGE = """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY image_id) AS rank, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS s FROM images),
x AS (SELECT source AS query_id, rank, regexp_extract(source_file, '[^/]+$') AS name, CASE WHEN trim(scene) <> '' THEN """ + _STRIP.format("scene") + """ ELSE regexp_extract(source_file, '[^/]+$') END AS title, source_type, slide_index, page_index,
  CASE WHEN source_type = 'pptx' AND slide_index IS NOT NULL THEN 'Slide ' || slide_index WHEN source_type = 'pdf' AND page_index IS NOT NULL THEN 'Page ' || page_index ELSE regexp_extract(source_file, '[^/]+$') END AS loc,
  """ + _STRIP.format("CASE WHEN caption_short <> '' THEN caption_short ELSE coalesce(caption_detailed, '') END") + """ AS caption, cases[1] AS use_case, image_id % 9 = 0 AS missing, s % 2 = 1 AS refinement FROM r WHERE rank <= 1 + s % 12),"""
_ANSWER = _PAGE + """
g AS (SELECT query_id, name, count(*) AS n, arg_min(title, rank) AS title, arg_min(source_type, rank) AS st, arg_min(loc, rank) AS loc, coalesce(list_sort(list(DISTINCT slide_index) FILTER (slide_index IS NOT NULL)), []) AS sl, coalesce(list_sort(list(DISTINCT page_index) FILTER (page_index IS NOT NULL)), []) AS pg FROM x GROUP BY query_id, name),
p AS (SELECT query_id, name, n, CASE WHEN n = 1 AND st IN ('pptx', 'pdf') THEN '1 from **' || title || '** (' || lower(loc) || ')' WHEN n = 1 THEN '1 standalone image (**' || title || '**)'
  WHEN len(sl) > 0 THEN n || ' from **' || name || '** (slides ' || CASE WHEN len(sl) <= 4 THEN array_to_string(sl, ', ') ELSE sl[1] || ', ' || sl[2] || ', … and ' || (len(sl) - 2) || ' more' END || ')'
  WHEN len(pg) > 0 THEN n || ' from **' || name || '** (pages ' || CASE WHEN len(pg) <= 4 THEN array_to_string(pg, ', ') ELSE pg[1] || ', ' || pg[2] || ', … and ' || (len(pg) - 2) || ' more' END || ')'
  ELSE n || ' from **' || name || '**' END AS part FROM g),
l AS (SELECT query_id, list(part ORDER BY n DESC, name) AS ps FROM p GROUP BY query_id),
summary AS (SELECT query_id, CASE len(ps) WHEN 1 THEN ps[1] WHEN 2 THEN ps[1] || ' and ' || ps[2] ELSE array_to_string(ps[:-2], ', ') || ', and ' || ps[-1] END AS su FROM l),
y AS (SELECT *, CASE WHEN length(caption) <= 120 THEN caption ELSE regexp_replace(left(caption, 117), '\\s+$', '') || '...' END AS c120, CASE WHEN caption = '' THEN 'No caption' WHEN length(caption) <= 100 THEN caption ELSE regexp_replace(left(caption, 97), '\\s+$', '') || '...' END AS c100 FROM x),
u AS (SELECT query_id, lower(use_case) AS k, arg_min(use_case, rank) AS v, min(rank) AS o FROM x WHERE use_case <> '' GROUP BY 1, 2), uses AS (SELECT query_id, list(v ORDER BY o)[:5] AS us FROM u GROUP BY 1),
q AS (SELECT query_id, count(*) AS n, list(c120 ORDER BY rank) FILTER (c120 <> '') AS caps, list('• **' || title || '**' || CASE WHEN source_type IN ('pptx', 'pdf') THEN ' (' || loc || ')' ELSE '' END || ' — ' || c100 ORDER BY rank)[:3] AS lines, count(*) FILTER (missing) AS gone, bool_or(refinement) AS refinement FROM y GROUP BY query_id),
h AS (SELECT *, CASE WHEN n > 3 THEN 'See all ' || n || ' in the results panel. ' ELSE '' END || CASE WHEN refinement THEN 'You can keep refining (e.g. "only the charts" or "from last month").' ELSE 'You can refine with something like "only the charts" or "from last month."' END AS hint FROM q JOIN summary USING (query_id) LEFT JOIN uses USING (query_id))
SELECT query_id, CASE WHEN refinement THEN 'Narrowed from your previous search — ' ELSE '' END
  || CASE WHEN n <= 3 THEN 'I found ' || n || CASE WHEN n = 1 THEN ' image (' ELSE ' images (' END || su || ')' || CASE WHEN len(caps) > 0 THEN ': ' || array_to_string(caps, '; ') ELSE '.' END || ' ' || hint
     ELSE 'I found **' || n || '** images that match. ' || su || '.' || chr(10) || chr(10) || '**Highlights:**' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || chr(10) || hint END
  || CASE WHEN len(us) > 0 THEN chr(10) || '**Use cases:**' || chr(10) || array_to_string(list_transform(us, lambda c: '- ' || c), chr(10)) ELSE '' END
  || CASE WHEN gone > 0 THEN chr(10) || chr(10) || '(' || gone || CASE WHEN gone = 1 THEN ' result' ELSE ' results' END || ' missing image files or blobs — re-ingest your source folder with `--force`.)' ELSE '' END AS answer FROM h"""


@query("r04_template_answer", sql("images", _ANSWER))
def template_answer(spark, d):
    """Replies to pages of one to twelve results."""
    i = images(spark, d)
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    page = i.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("image_id"))).where(F.col("rank") <= 12).where(F.col("rank") <= 1 + number % 12)
    case = F.get("cases", F.lit(0))
    return P.answers(page.select(F.col("source").alias("query_id"), "rank", F.col("scene").alias("image_name"), "source_file", "source_type", "slide_index", "page_index", "caption_short", "caption_detailed", case.alias("use_case"), (F.col("image_id") % 9 == 0).alias("missing"), (number % 2 == 1).alias("refinement")))


_REPLY = _ANSWER.replace("SELECT query_id, CASE WHEN refinement", ", a AS (SELECT query_id, CASE WHEN refinement", 1).rstrip() + ") SELECT query_id, CASE WHEN CAST(regexp_extract(query_id, '[0-9]+') AS INTEGER) % 3 = 0 THEN answer ELSE rtrim('In short: ' || left(answer, 40)) END AS reply FROM a"


@query("r05_conversational_reply", sql("images", _REPLY))
def conversational_reply(spark, d):
    """A model's reply, or the template's where the model fails, reply by reply."""
    from ..operators.models import replied

    def model(query: str, answer: str) -> str:
        if int(query[3:]) % 3 == 0:
            raise TimeoutError("no answer in time")
        return "In short: " + answer[:40]

    return replied(template_answer(spark, d), "query_id", "answer", model)


@query("r06_eval_summary", sql("vectors", _CASES + ", a AS (SELECT count(*) AS n, avg(mrr) AS mrr, " + ", ".join(f"avg(CAST(hit_{k} AS DOUBLE)) AS h{k}" for k in (1, 3, 5, 10)) + ", avg(recall_10) AS r10 FROM m) SELECT 'Similar          n=' || n || '  ' || " + " || '  ' || ".join(f"'Hit@{k}=' || CAST(round_even(h{k} * 100, 0) AS INTEGER) || '%'" for k in (1, 3, 5, 10)) + " || '  MRR=' || printf('%.2f', mrr) || '  Recall@10=' || CAST(round_even(r10 * 100, 0) AS INTEGER) || '%' AS line FROM a"))
def eval_summary(spark, d):
    """The line of a run of cases: every hundredth image looked up among all."""
    return P.eval_line("Similar", O.macro(_cases(spark, d)), (1, 3, 5, 10))


@query(
    "r06_eval_cases",
    sql(
        "vectors",
        _CASES
        + """, e AS (
  SELECT rel.case_id, coalesce(bool_or(rank <= 10), false) AS hit,
    string_agg('  expected ' || rel.id || '  rank=' || coalesce(CAST(rank AS VARCHAR), '—'), chr(10) ORDER BY pos) AS lines
  FROM rel LEFT JOIN ranks USING (case_id, id) GROUP BY rel.case_id),
g AS (SELECT case_id, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY rank) AS got FROM ranks GROUP BY case_id)
SELECT case_id, NOT hit AS failed,
  CASE WHEN hit THEN 'OK    ' ELSE 'FAIL  ' END || case_id || ' [similar]' || chr(10) || lines || coalesce(chr(10) || '  got: ' || got, '') AS text
FROM e LEFT JOIN g USING (case_id)""",
    ),
)
def eval_cases(spark, d):
    """Each case of that run: what was expected, where it came, and what was found."""
    ranked, relevant = _case_rows(spark, d)
    return P.eval_cases(ranked, relevant, "similar", 10)


def _sample_sql(order: int, lead: str, rows: str, limit: int, longest: int | None) -> str:
    """A section of sampled values; `rows` gives (value, a, b)."""
    return f"SELECT {order} AS k, '{lead}' || chr(10) || string_agg('  - ' || value, chr(10) ORDER BY o) AS text FROM (SELECT arg_min(value, (a, b)) AS value, min((a, b)) AS o FROM (SELECT {_STRIP.format('value')} AS value, a, b FROM ({rows})) WHERE value <> ''{f' AND length(value) <= {longest}' if longest else ''} GROUP BY lower(value) ORDER BY o LIMIT {limit}) HAVING count(*) > 0"


def _count_sql(order: int, lead: str, rows: str, limit: int, entry: str) -> str:
    return f"SELECT {order} AS k, '{lead}' || string_agg({entry}, ', ' ORDER BY n DESC, o) AS text FROM (SELECT value, count(*) AS n, min((a, b)) AS o FROM (SELECT {_STRIP.format('value')} AS value, a, b FROM ({rows})) WHERE value <> '' GROUP BY value ORDER BY n DESC, o LIMIT {limit}) HAVING count(*) > 0"


def _each_sql(column: str) -> str:
    return f"SELECT unnest({column}) AS value, image_id AS a, generate_subscripts({column}, 1) AS b FROM act"


_CONTEXT = ", act AS (SELECT * FROM images WHERE NOT deleted), parts AS (" + " UNION ALL ".join([
    "SELECT 0 AS k, 'Indexed images: ' || count(*) AS text FROM act",
    _count_sql(1, "File types: ", "SELECT source_type AS value, image_id AS a, 0 AS b FROM act", 3, "value || '=' || n"),
    _count_sql(2, "Asset types: ", "SELECT lower(coalesce(asset_type, '')) AS value, image_id AS a, 0 AS b FROM act", 8, "value || '=' || n"),
    _count_sql(3, "Common tags: ", f"SELECT lower(value) AS value, a, b FROM ({_each_sql('tags')})", 12, "value"),
    _sample_sql(4, "Sample image names:", "SELECT scene AS value, image_id AS a, 0 AS b FROM act", 8, 120),
    _sample_sql(5, "Sample use cases:", "SELECT source AS value, image_id AS a, 0 AS b FROM act", 6, 120),
    _sample_sql(6, "Sample search aliases:", _each_sql("aliases"), 8, 80),
    _sample_sql(7, "Sample captions:", "SELECT caption_short AS value, image_id AS a, 0 AS b FROM act", 12, 200),
    _sample_sql(8, "Sample recommended search phrases:", _each_sql("cases"), 8, None),
    "SELECT 9 AS k, 'Top source files (grounding only — do not suggest filename-filter searches):' || chr(10) || string_agg('  - ' || value || ' (' || kind || '): ' || n, chr(10) ORDER BY n DESC, o) AS text FROM (SELECT regexp_extract(source_file, '[^/]+$') AS value, count(*) AS n, min(image_id) AS o, arg_max(source_type, image_id) AS kind FROM act GROUP BY 1 ORDER BY n DESC, o LIMIT 8) HAVING count(*) > 0",
    _count_sql(10, "Authors: ", "SELECT coalesce(author, '') AS value, image_id AS a, 0 AS b FROM act", 5, "value"),
    "SELECT 11 AS k, 'Source modified date range: ' || CAST(min(modified_at) AS DATE) || ' to ' || CAST(max(modified_at) AS DATE) AS text FROM act HAVING count(modified_at) > 0",
]) + ") SELECT string_agg(text, chr(10) ORDER BY k) AS context FROM parts"


@query("r07_corpus_context", sql("images", _CONTEXT))
def corpus_context(spark, d):
    i = active(spark, d)
    return P.corpus_context(i.withColumn("image_name", F.col("scene")).withColumn("use_case", F.col("source")))


_KINDS = """CASE WHEN trim(coalesce(asset_type, '')) = '' THEN 'unclassified' WHEN lower(trim(asset_type)) IN (TYPES) THEN lower(trim(asset_type)) ELSE 'other' END"""


@query(
    "r08_audit_report",
    sql(
        "images",
        f""", t AS (SELECT {_KINDS.replace("TYPES", ", ".join(f"'{t}'" for t in V.ASSET_TYPES))} AS kind, count(*) AS n FROM images GROUP BY 1),
total AS (SELECT count(*) AS total, (SELECT coalesce(sum(n), 0) FROM t WHERE kind = 'unclassified') AS none, (SELECT coalesce(sum(n), 0) FROM t WHERE kind = 'other') AS other FROM images),
types AS (SELECT unnest([{", ".join(f"'{t}'" for t in V.ASSET_TYPES)}]) AS kind, unnest(range({len(V.ASSET_TYPES)})) AS k),
lines AS (SELECT string_agg(printf('  %-14s %5d  (%5.1f%%)', kind, CAST(coalesce(n, 0) AS BIGINT), round_even(100e0 * coalesce(n, 0) / total, 1)), chr(10) ORDER BY k) AS l FROM types LEFT JOIN t USING (kind), total),
h AS (SELECT unnest(['chart_tag_vs_diagram', 'screenshot_tag_vs_photo', 'logo_tag_vs_illustration', 'flowchart_caption_vs_chart']) AS signal,
  unnest(['chart|graph|bar', 'screenshot|ui|browser', 'logo|wordmark|brand', 'flowchart|infographic|process diagram']) AS needles,
  unnest(['diagram', 'photo', 'illustration', 'chart']) AS kind, unnest([{", ".join(f"'{x}'" for x in V.CONFUSIONS.values())}]) AS told, unnest(range(4)) AS k),
c AS (SELECT signal, told, k, (SELECT count(*) FROM images WHERE lower(trim(coalesce(asset_type, ''))) = h.kind
  AND regexp_matches(lower(CASE WHEN k = 3 THEN caption_short || ' ' || caption_detailed || ' ' || array_to_string(tags, ' ') ELSE array_to_string(tags, ' ') END), needles)) AS n FROM h),
w AS (
  SELECT 0 AS k, printf('  WARN: %d row(s) (%.1f%%) lack asset_type', CAST(none AS BIGINT), round_even(100e0 * none / total, 1)) AS l FROM total WHERE none > 0
  UNION ALL SELECT 1, printf('  WARN: other is %.1f%% (threshold 15%%)', round_even(100e0 * other / total, 1)) FROM total WHERE 100e0 * other / total >= 15
  UNION ALL SELECT 2 + k, printf('  WARN: %s — %d cases (%s)', signal, n, told) FROM c WHERE n >= 10)
SELECT 'Asset type audit (taxonomy v1)' || chr(10) || 'Total records: ' || total || chr(10) || printf('Unclassified: %d (%.1f%%)', CAST(none AS BIGINT), round_even(100e0 * none / total, 1)) || chr(10) || chr(10)
  || 'Distribution:' || chr(10) || l || chr(10) || chr(10) || 'Confusion signals (heuristic):' || chr(10)
  || (SELECT string_agg('  ' || signal || ': ' || n, chr(10) ORDER BY k) FROM c)
  || coalesce(chr(10) || chr(10) || 'Warnings:' || chr(10) || (SELECT string_agg(l, chr(10) ORDER BY k) FROM w), '') AS report
FROM total, lines""",
    ),
)
def audit_report(spark, d):
    """The audit of asset types as its text: a table, confusions and warnings."""
    i = images(spark, d)
    return P.audit_report(O.distribution(i), O.confusion(i))


@query("r08_audit_gate", sql("images", "SELECT round(100e0 * count(*) FILTER (trim(coalesce(asset_type, '')) = '') / count(*), 2) > 5e0 AS refused FROM images"))
def audit_gate(spark, d):
    """Whether freezing the taxonomy is refused: too many images are unclassified."""
    p = O.distribution(images(spark, d)).where("asset_type = 'unclassified'")
    return p.select((F.col("percent") > 5.0).alias("refused"))


@query("r09_card_json", sql("images", """SELECT image_id, '{"image_id":' || image_id || ',"source":"' || source || '","type":"' || source_type || '"}' AS card FROM images"""))
def card_json(spark, d):
    return images(spark, d).select("image_id", F.to_json(F.struct("image_id", "source", F.col("source_type").alias("type"))).alias("card"))


@query("u01_embedding_hook")
def embedding_hook(spark, d):
    from ..operators.models import embed_text

    return images(spark, d).select("image_id", embed_text("text").alias("vector"))


@query("u02_rerank_hook", sql("images", "SELECT image_id, len(list_intersect(list_distinct(regexp_extract_all(lower(left(text, 8000)), '[a-z0-9]+')), ['the', 'of', 'and'])) / 3e0 AS score FROM images"))
def rerank_hook(spark, d):
    from ..operators.models import overlap_score

    return images(spark, d).select("image_id", overlap_score(F.lit("the of AND the"), F.col("text")).alias("score"))


@query("u03_caption_hook", sql("images", "SELECT image_id, CASE WHEN image_id % 4 = 0 THEN '[caption failed]' ELSE '{\"image_name\": \"' || source || '\"}' END AS caption FROM images"))
def caption_hook(spark, d):
    from ..operators.models import caption

    i = images(spark, d).select("image_id", F.when(F.col("image_id") % 4 != 0, F.col("source")).alias("name"))
    return i.mapInPandas(caption, "image_id long, name string, caption string").select("image_id", "caption")


@query("u04_parse_hook", "SELECT conv_id, turn, text AS semantic_query, 10 AS top_k FROM conversations WHERE role = 'user'")
def parse_hook(spark, d):
    """Without a model the text itself is the query."""
    from .spec import spec_of

    raw = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit(None).cast("string").alias("semantic_query"), F.lit(None).cast("int").alias("top_k"), F.lit(None).cast("array<string>").alias("file_types"), F.col("text").alias("raw_text"))
    return spec_of(raw).select("conv_id", "turn", "semantic_query", "top_k")


@query("u05_slide_batches", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch, count(*) OVER (PARTITION BY conv_id) AS slides, turn FROM conversations")
def slide_batches(spark, d):
    """Slides in batches for a description model."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", F.floor((F.row_number().over(w) - 1) / 3).alias("batch"), F.count("*").over(Window.partitionBy("conv_id")).alias("slides"), "turn")


#: Decks as they are, and what a manifest of the last run holds of them: every third deck had another slide, the next another request.
_DECKS = """WITH s AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS h, sha256(CASE WHEN conv_id % 3 = 2 AND turn % 2 = 1 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS was FROM conversations),
d AS (SELECT conv_id, sha256(string_agg(h, chr(10) ORDER BY turn, h)) AS slides, sha256('top_k=10;axis=balanced') AS request, sha256(string_agg(was, chr(10) ORDER BY turn, h)) AS slides_was, sha256(CASE WHEN conv_id % 3 = 1 THEN 'top_k=5;axis=balanced' ELSE 'top_k=10;axis=balanced' END) AS request_was FROM s GROUP BY conv_id),
c AS (SELECT DISTINCT was FROM s WHERE conv_id % 5 <> 4)
SELECT conv_id, CASE WHEN conv_id % 5 = 4 THEN 'describe+search' WHEN slides = slides_was AND request = request_was THEN 'manifest' WHEN slides = slides_was THEN 'search' ELSE 'describe+search' END AS plan, (SELECT count(*) FROM s WHERE s.conv_id = d.conv_id AND h NOT IN (FROM c)) AS to_describe FROM d"""


@query("u08_deck_plan", _DECKS)
def deck_plan(spark, d):
    """What a deck needs, by fingerprints of its slides and of the request: its manifest, a new search, or descriptions too.

    Every fifth deck has no manifest; a slide is described again only where no deck's cache has its text.
    """
    from ..operators.decks import fingerprints, plan

    now = table(spark, d, "conversations").select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide"), F.coalesce("text", F.lit("")).alias("text"), F.lit("top_k=10;axis=balanced").alias("request"))
    changed = (F.col("deck_id") % 3 == 2) & (F.col("slide") % 2 == 1)
    before = now.where("deck_id % 5 <> 4").withColumn("text", F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("request", F.when(F.col("deck_id") % 3 == 1, "top_k=5;axis=balanced").otherwise(F.col("request")))
    cache = before.select(F.sha2("text", 256).alias("hash")).distinct()
    return plan(now, fingerprints(before), cache).select(F.col("deck_id").alias("conv_id"), "plan", "to_describe")


@query("u10_caption_vectors", sql("images", "SELECT image_id, trim(caption_short) <> '' AS embedded FROM images"))
def caption_vectors(spark, d):
    from ..operators.models import embed_text

    return images(spark, d).select("image_id", embed_text("caption_short").isNotNull().alias("embedded"))
