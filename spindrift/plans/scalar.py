"""Queries of the scalar functions (F), over catalogue columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import query
from .views import images, sql, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TAG_SQL = """, t AS (SELECT image_id, regexp_replace(lower(trim(tag)), '\\s+', ' ', 'g') AS t FROM (SELECT image_id, unnest(tags) AS tag FROM images))"""
_SYNONYMS = ", ".join(f"('{k}', '{v}', {len(k)})" for k, v in V.ASSET_SYNONYMS.items())
_TYPES = ", ".join(f"'{t}'" for t in V.ASSET_TYPES)
_EXCEPT = ", ".join(f"'{t}'" for t in V.PLURAL_EXCEPTIONS)
_NORM = f"""CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN CASE WHEN left(t, length(t) - 3) || 'y' IN ({_EXCEPT}) THEN t ELSE left(t, length(t) - 3) || 'y' END
  WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' AND t NOT IN ({_EXCEPT}) THEN left(t, length(t) - 1) ELSE t END"""


@query("f01_normalize_tag", sql("images", _TAG_SQL + f" SELECT image_id, t AS tag, {_NORM} AS normalized FROM t"))
def normalize_tag(spark, d):
    tags = images(spark, d).select("image_id", F.explode("tags").alias("tag"))
    return tags.select("image_id", F.regexp_replace(F.lower(T.strip("tag")), r"\s+", " ").alias("tag"), T.normalize_tag("tag").alias("normalized"))


@query("f02_text_tokens", sql("images", "SELECT image_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM images"))
def text_tokens(spark, d):
    return images(spark, d).select("image_id", T.tokens("text").alias("tokens"))


@query("v05_index_tokens", sql("images", "SELECT image_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS tokens FROM images"))
def index_tokens(spark, d):
    return images(spark, d).select("image_id", T.index_tokens("text").alias("tokens"))


_ASSET_SQL = f""", syn AS (SELECT * FROM (VALUES {_SYNONYMS}) v(s, c, n)),
keys AS (SELECT image_id, asset_type, replace(lower(trim(coalesce(asset_type, ''))), '_', ' ') AS k FROM images),
typed AS (SELECT image_id, asset_type, CASE WHEN k IN ({_TYPES}) THEN k ELSE coalesce((SELECT c FROM syn WHERE s = k), (SELECT arg_max(c, n) FROM syn WHERE contains(k, s)), 'other') END AS canonical FROM keys)"""


@query("f03_asset_type", sql("images", _ASSET_SQL + " SELECT image_id, canonical FROM typed"))
def asset_type(spark, d):
    return images(spark, d).select("image_id", T.asset_type("asset_type").alias("canonical"))


@query(
    "f04_query_asset_type",
    sql(
        "images",
        f""", syn AS (SELECT * FROM (VALUES {_SYNONYMS}) v(s, c, n)),
t AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN asset_type ELSE upper(asset_type) || 's ' END AS word FROM images WHERE asset_type IS NOT NULL),
n AS (SELECT image_id, word, {_NORM} AS k FROM (SELECT image_id, word, lower(trim(word)) AS t FROM t))
SELECT image_id, word, CASE WHEN k IN ({_TYPES}) THEN k ELSE (SELECT c FROM syn WHERE s = k) END AS type FROM n""",
    ),
)
def query_asset_type(spark, d):
    """The types that people's labels name, as they are and in the plural."""
    word = F.when(F.col("image_id") % 2 == 0, F.col("asset_type")).otherwise(F.concat(F.upper("asset_type"), F.lit("s ")))
    return images(spark, d).where("asset_type is not null").select("image_id", word.alias("word")).select("image_id", "word", T.query_asset_type("word").alias("type"))


@query("f05_asset_label", sql("images", _ASSET_SQL + " SELECT image_id, CASE WHEN trim(coalesce(asset_type, '')) = '' THEN '' ELSE upper(left(canonical, 1)) || substring(canonical, 2) END AS label FROM typed"))
def asset_label(spark, d):
    return images(spark, d).select("image_id", T.asset_label("asset_type").alias("label"))


@query("f06_caption_document", sql("images", _ASSET_SQL + r""" SELECT i.image_id, array_to_string(list_filter(list_concat(
  [CASE WHEN trim(coalesce(i.asset_type, '')) = '' THEN '' ELSE 'asset_type: ' || upper(left(canonical, 1)) || substring(canonical, 2) END, coalesce(scene, ''), source, coalesce(caption_short, ''), coalesce(caption_detailed, '')], tags, cases, aliases), lambda x: x <> ''), ' ' || chr(10) || ' ') AS document
FROM images i JOIN typed USING (image_id)"""))
def caption_document(spark, d):
    i = images(spark, d)
    label = T.asset_label("asset_type")
    parts = (F.when(label != "", F.array(F.concat(F.lit("asset_type: "), label))), T.one("scene"), T.one("source"), T.one("caption_short"), T.one("caption_detailed"), i.tags, i.cases, i.aliases)
    return i.select("image_id", T.joined(" \n ", *parts).alias("document"))


@query("f07_rerank_document", sql("images", r"""SELECT image_id, array_to_string(list_filter(list_concat([coalesce(scene, ''), left(trim(text), 600), coalesce(caption_short, '')],
  [CASE WHEN len(tags) > 0 THEN 'tags: ' || array_to_string(list_slice(tags, 1, 8), ', ') ELSE '' END, CASE WHEN len(aliases) > 0 THEN 'aliases: ' || array_to_string(list_slice(aliases, 1, 8), ', ') ELSE '' END,
   CASE WHEN len(cases) > 0 THEN 'recommended: ' || array_to_string(list_slice(cases, 1, 3), '; ') ELSE '' END]), lambda x: x <> ''), chr(10)) AS document FROM images"""))
def rerank_document(spark, d):
    i = images(spark, d)
    parts = (T.one("scene"), T.one(F.left(F.trim("text"), F.lit(600))), T.one("caption_short"), T.labelled("tags: ", i.tags, ", ", 8), T.labelled("aliases: ", i.aliases, ", ", 8), T.labelled("recommended: ", i.cases, "; ", 3))
    return i.select("image_id", T.joined("\n", *parts).alias("document"))


@query("f08_embed_context", sql("images", "SELECT image_id, left(array_to_string(list_filter([source, coalesce(scene, ''), coalesce(caption_short, '')], lambda x: x <> ''), ' | '), 480) AS context FROM images"))
def embed_context(spark, d):
    return images(spark, d).select("image_id", F.left(T.joined(" | ", T.one("source"), T.one("scene"), T.one("caption_short")), F.lit(480)).alias("context"))


@query("f09_caption_context", sql("images", r"""SELECT image_id, CASE WHEN length('Title: ' || source || chr(10) || 'Notes: ' || caption_short || chr(10) || 'Body: ' || caption_detailed) <= 250
  THEN 'Title: ' || source || chr(10) || 'Notes: ' || caption_short || chr(10) || 'Body: ' || caption_detailed
  WHEN length('Title: ' || source || chr(10) || 'Notes: ' || caption_short) <= 250 THEN 'Title: ' || source || chr(10) || 'Notes: ' || caption_short ELSE 'Title: ' || source END AS context
FROM (SELECT * FROM images WHERE caption_short <> '' AND caption_detailed <> '')"""))
def caption_context(spark, d):
    """Sections by priority; the last ones fall away until the text fits."""
    i = images(spark, d).where("caption_short <> '' AND caption_detailed <> ''")
    sections = F.array(F.concat(F.lit("Title: "), "source"), F.concat(F.lit("Notes: "), "caption_short"), F.concat(F.lit("Body: "), "caption_detailed"))
    fitted = F.filter(F.transform(F.sequence(F.size(sections), F.lit(1)), lambda n: F.array_join(F.slice(sections, 1, n), "\n")), lambda t: F.length(t) <= 250)
    return i.select("image_id", F.coalesce(F.try_element_at(fitted, F.lit(1)), sections[0]).alias("context"))


_REASONS = r"""list_filter([CASE WHEN trim(coalesce(scene, '')) = '' THEN 'missing_image_name' END, CASE WHEN s = '' THEN 'missing_short_caption' END,
  CASE WHEN s <> '' AND (length(s) < 15 OR len(regexp_extract_all(s, '\S+')) < 4) THEN 'short_caption_too_brief' END, CASE WHEN regexp_replace(coalesce(caption_detailed, ''), '^\s+|\s+$', '', 'g') = '' THEN 'missing_detailed_description' END,
  CASE WHEN regexp_matches(s, '(?i)GENERIC') THEN 'generic_caption_opener' END, CASE WHEN trim(coalesce(scene, '')) = '' AND len(list_filter(aliases, lambda x: trim(x) <> '')) = 0 THEN 'missing_scene_and_objects' END,
  CASE WHEN len(list_filter(tags, lambda x: trim(x) <> '')) < 3 THEN 'insufficient_tags' END, CASE WHEN len(list_filter(cases, lambda x: trim(x) <> '')) < 3 THEN 'insufficient_recommended_cases' END,
  CASE WHEN len(list_filter(aliases, lambda x: trim(x) <> '')) < 2 THEN 'insufficient_aliases' END], lambda x: x IS NOT NULL)""".replace("GENERIC", "|".join(V.GENERIC_OPENERS))


@query("f10_caption_quality", sql("images", f", a AS (SELECT *, {_STRIP.format('caption_short')} AS s FROM images), b AS (SELECT image_id, s, {_REASONS} AS r FROM a) SELECT image_id, CASE WHEN s = '[caption failed]' THEN ['caption_failed_marker'] ELSE r END AS reasons, CASE WHEN s = '[caption failed]' THEN 'failed' WHEN len(r) > 0 THEN 'weak' ELSE 'ok' END AS quality FROM b"))
def caption_quality(spark, d):
    i = images(spark, d)
    reasons = T.caption_reasons(i.scene, i.caption_short, i.caption_detailed, i.scene, i.aliases, F.lit(""), F.lit(False), i.tags, i.cases, i.aliases)
    return i.select("image_id", reasons.alias("reasons"), T.caption_quality(reasons).alias("quality"))


#: A caption as models answer, made from catalogue columns; every third is the legacy flat form, every seventh is broken.
def _answers(spark, d):
    i = images(spark, d)
    nested = F.to_json(F.struct(F.col("scene").alias("image_name"), F.struct(F.col("source").alias("scene"), F.col("aliases").alias("objects")).alias("grounded"), F.struct(F.col("tags")).alias("search")))
    flat = F.to_json(F.struct(F.col("scene").alias("image_name"), F.col("source").alias("scene"), F.col("aliases").alias("objects"), F.col("tags")))
    body = F.when(i.image_id % 3 == 0, flat).otherwise(nested)
    answer = F.when(i.image_id % 7 == 0, "no json here").when(i.image_id % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    return i.select("image_id", "scene", "source", "tags", "aliases", answer.alias("answer"))


_NESTED = "image_name string, scene string, objects array<string>, tags array<string>, grounded struct<scene string, objects array<string>>, search struct<tags array<string>>"


@query("f11_caption_valid", sql("images", "SELECT image_id, image_id % 7 <> 0 AND image_id % 3 <> 0 AND len(tags) BETWEEN 3 AND 8 AS valid FROM images"))
def caption_valid(spark, d):
    """Whether an answer has the nested form and its sizes are within bounds."""
    a = _answers(spark, d).withColumn("c", F.from_json(T.lenient_json("answer"), _NESTED))
    valid = F.col("c.grounded").isNotNull() & F.col("c.search").isNotNull() & F.size("c.search.tags").between(3, 8)
    return a.select("image_id", F.coalesce(valid, F.lit(False)).alias("valid"))


@query("f12_caption_coerced", sql("images", "SELECT image_id, CASE WHEN image_id % 7 = 0 THEN '' ELSE scene END AS image_name, CASE WHEN image_id % 7 = 0 THEN '' ELSE source END AS scene, CASE WHEN image_id % 7 = 0 THEN [] ELSE tags END AS tags, CASE WHEN image_id % 7 = 0 THEN [] ELSE aliases END AS objects FROM images"))
def caption_coerced(spark, d):
    """Nested or flat answers as one struct with defaults."""
    a = _answers(spark, d).withColumn("c", F.from_json(T.lenient_json("answer"), _NESTED))
    none = F.array().cast("array<string>")
    return a.select("image_id", T.text_or_empty("c.image_name").alias("image_name"), F.coalesce("c.grounded.scene", "c.scene", F.lit("")).alias("scene"), F.coalesce("c.search.tags", "c.tags", none).alias("tags"), F.coalesce("c.grounded.objects", "c.objects", none).alias("objects"))


@query("f13_lenient_json", sql("images", "SELECT image_id, image_id % 7 <> 0 AS found FROM images"))
def lenient_json(spark, d):
    return _answers(spark, d).select("image_id", F.from_json(T.lenient_json("answer"), _NESTED).isNotNull().alias("found"))


@query("f14_json_list", sql("images", "SELECT image_id, CASE WHEN image_id % 4 = 0 THEN [] ELSE tags END AS tags FROM images"))
def json_list(spark, d):
    i = images(spark, d)
    stored = F.when(i.image_id % 8 == 0, "{\"a\": 1}").when(i.image_id % 4 == 0, "not json").otherwise(F.to_json("tags"))
    return i.select("image_id", T.json_list(stored).alias("tags"))


@query(
    "f15_query_spec",
    sql(
        "images",
        f""" SELECT image_id,
  CASE WHEN image_id % 3 = 0 OR {_STRIP.format("caption_short")} = '' THEN source ELSE {_STRIP.format("caption_short")} END AS semantic_query,
  CASE WHEN image_id % 4 = 0 THEN 10 ELSE greatest(1, least(50, image_id % 70 - 5)) END AS top_k,
  CASE image_id % 3 WHEN 0 THEN ['pptx', 'image'] WHEN 1 THEN ['pdf'] ELSE []::VARCHAR[] END AS file_types FROM images""",
    ),
)
def query_spec(spark, d):
    """Parsed queries with defaults, clamped sizes and known file types."""
    from .spec import spec_of

    i = F.col("image_id")
    kinds = F.when(i % 3 == 0, F.array(*map(F.lit, (".PPTX", "jpeg", "Images", "exe")))).when(i % 3 == 1, F.array(F.lit("pdf")))
    raw = images(spark, d).select("image_id", F.when(i % 3 != 0, F.col("caption_short")).alias("semantic_query"), F.when(i % 4 != 0, i % 70 - 5).alias("top_k"), kinds.alias("file_types"), F.col("source").alias("raw_text"))
    return spec_of(raw).select("image_id", "semantic_query", "top_k", "file_types")


@query(
    "f16_lenient_date",
    """SELECT event_id, CASE WHEN event_id % 6 = 3 THEN date_trunc('second', ts) WHEN event_id % 6 < 3 THEN date_trunc('day', ts) END AS parsed FROM events""",
)
def lenient_date(spark, d):
    """Times of events as people write them: three forms of a day, one of a second, and two that aren't dates."""
    at = F.col("ts")
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "' 'yyyy-MM-dd'T'HH:mm:ss' '", "'about 'yyyy", "yyyy-'13'-dd")
    text = F.element_at(F.array(*(F.date_format(at, f) for f in forms)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.lenient_date(text).cast("timestamp_ntz").alias("parsed"))


@query(
    "s06_pdf_date",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END AS parsed FROM events""",
)
def pdf_date(spark, d):
    """Times of events as PDFs have them: to the second, to the day, and three that are bad."""
    at = F.col("ts")
    forms = ("'D:'yyyyMMddHHmmss'+01'", "'D:'yyyyMMdd", "'D:'yyyyMMddHHmm'0x'", "'D:'yyyy", "'created in 'yyyy")
    text = F.element_at(F.array(*(F.date_format(at, f) for f in forms)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.pdf_date(text).cast("timestamp_ntz").alias("parsed"))


_PROVENANCE = r"""CASE WHEN source_type = 'pptx' AND coalesce(slide_index, 0) <> 0 THEN 'Slide ' || slide_index || ' of ' || regexp_extract(source_file, '[^/]+$') WHEN source_type = 'pdf' AND coalesce(page_index, 0) <> 0 THEN 'Page ' || page_index || ' of ' || regexp_extract(source_file, '[^/]+$')
  ELSE regexp_extract(source_file, '[^/]+$') END || CASE WHEN modified_at IS NOT NULL THEN ', modified ' || strftime(modified_at, '%Y-%m-%d') ELSE '' END || CASE WHEN coalesce(author, '') <> '' THEN ', by ' || author ELSE '' END"""


@query("f17_provenance", sql("images", f"SELECT image_id, {_PROVENANCE} AS line FROM images"))
def provenance(spark, d):
    i = images(spark, d)
    return i.select("image_id", T.provenance(i.source_type, i.slide_index, i.page_index, i.source_file, i.modified_at, i.author).alias("line"))


@query("f18_explanation", sql("images", r"""SELECT image_id, array_to_string(list_filter([caption_short, CASE WHEN len(tags) > 0 THEN 'tags: ' || array_to_string(list_slice(tags, 1, 6), ', ') ELSE '' END, CASE WHEN trim(text) <> '' THEN 'text: ' || left(trim(text), 120) ELSE '' END], lambda x: x <> ''), ' | ') AS line FROM images"""))
def explanation(spark, d):
    i = images(spark, d)
    text = F.trim("text")
    return i.select("image_id", T.joined(" | ", T.one("caption_short"), T.labelled("tags: ", i.tags, ", ", 6), F.when(text != "", F.array(F.concat(F.lit("text: "), F.left(text, F.lit(120)))))).alias("line"))


def _anchors(kind: str) -> str:
    a = V.MATCH_ANCHORS[kind]
    steps = " ".join(f"WHEN x <= {r1}e0 THEN {d0}e0 + (x - {r0}e0) / ({r1}e0 - {r0}e0) * {d1 - d0}e0" for (r0, d0), (r1, d1) in zip(a, a[1:]))
    return f"CAST(round_even(CASE {steps} ELSE {a[-1][1]}e0 END, 0) AS INTEGER)"


@query("f19_match_percent", sql("searches", f", s AS (SELECT id, greatest(0e0, least(1e0, top_score * 1.2e0 - 0.1e0)) AS x, id % 3 AS kind FROM searches) SELECT id, CASE kind WHEN 0 THEN {_anchors('rerank')} WHEN 1 THEN {_anchors('dense')} ELSE {_anchors('fusion')} END AS percent FROM s"))
def match_percent(spark, d):
    from .views import searches

    s = searches(spark, d)
    kind = F.when(s.id % 3 == 0, "rerank").when(s.id % 3 == 1, "dense").otherwise("fusion")
    return s.select("id", T.match_percent(s.top_score * 1.2 - 0.1, kind).alias("percent"))


@query("f20_truncated", sql("images", r"SELECT image_id, CASE WHEN length(t) <= 50 THEN t ELSE regexp_replace(left(t, 47), '\s+$', '') || '...' END AS short FROM (SELECT image_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM images)"))
def truncated(spark, d):
    return images(spark, d).select("image_id", T.truncated("text", 50).alias("short"))


@query("f21_basename", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS name FROM pages")
def basename(spark, d):
    return table(spark, d, "pages").select("page_id", T.basename("url").alias("name"))


@query("f22_safe_filename", r"SELECT page_id, CASE WHEN n = '' THEN 'upload' ELSE n END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS n FROM pages)")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename("url").alias("name"))


@query("f23_content_hash", sql("images", "SELECT image_id, content_hash FROM images"))
def content_hash(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), T.digest(F.col("text")).alias("content_hash"))


@query("f24_slide_hash", r"SELECT conv_id, sha256(string_agg(sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')), '|' ORDER BY turn)) AS deck_hash FROM conversations GROUP BY conv_id")
def slide_hash(spark, d):
    """Turns as slides: each one's normalised text hashed, a deck's hashes in order hashed again."""
    slides = table(spark, d, "conversations").select("conv_id", F.struct("turn", T.digest(T.slide_text("text")).alias("h")).alias("s"))
    return slides.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", T.digest(F.array_join("s.h", "|")).alias("deck_hash"))


@query("f25_fingerprint", sql("images", """SELECT source, left(sha256('{"count":' || count(*) || ',"first":' || min(image_id) || ',"last":' || max(image_id) || '}'), 32) AS fingerprint FROM images GROUP BY source"""))
def fingerprint(spark, d):
    g = images(spark, d).groupBy("source").agg(F.count("*").alias("count"), F.min("image_id").alias("first"), F.max("image_id").alias("last"))
    return g.select("source", T.digest(F.to_json(F.struct("count", "first", "last")), 32).alias("fingerprint"))


@query("f26_display_query", sql("searches", "SELECT id, CASE WHEN search_kind = 'view' THEN CAST(user_id AS VARCHAR) ELSE coalesce(nullif(CASE WHEN k % 3 = 0 THEN ' ' ELSE search_kind END, ' '), CASE WHEN k % 2 = 0 THEN CAST(user_id AS VARCHAR) END, '—') END AS shown FROM searches"))
def display_query(spark, d):
    from .views import searches

    s = searches(spark, d)
    user, semantic = s.user_id.cast("string"), F.when(s.k % 3 == 0, " ").otherwise(s.search_kind)
    filled = lambda c: F.when(~T.blank(c), c)
    return s.select("id", F.when(s.search_kind == "view", user).otherwise(F.coalesce(filled(semantic), F.when(s.k % 2 == 0, user), F.lit("—"))).alias("shown"))


@query("f27_event_projection", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, strftime(ts, '%Y-%m-%d') AS dt, event_type FROM events")
def event_projection(spark, d):
    """Schema on read: fields of a JSON document with defaults."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long, missing string"))
    return e.select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce("p.missing", F.lit("none")).alias("missing"), F.date_format("ts", "yyyy-MM-dd").alias("dt"), "event_type")


@query("f28_search_terms", sql("images", r", t AS (SELECT image_id, list_filter(list_transform(list_concat(aliases, tags, ['Photo', 'MAP']), lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS a FROM images), u AS (SELECT image_id, a, [x FOR x, i IN list_filter(a, lambda x: x NOT IN ('photo', 'map')) IF true] AS b FROM t) SELECT image_id, list_slice(list_filter(b, lambda x, i: list_position(b, x) = i), 1, 8) AS terms FROM u".replace("[x FOR x, i IN list_filter(a, lambda x: x NOT IN ('photo', 'map')) IF true]", f"list_filter(a, lambda x: x NOT IN ({_TYPES}))")))
def search_terms(spark, d):
    i = images(spark, d)
    return i.select("image_id", T.search_terms(F.concat("aliases", "tags", F.array(F.lit("Photo"), F.lit("MAP"))), 8, drop_types=True).alias("terms"))


@query("f29_filename_query", sql("images", "SELECT image_id, image_id % 5 < 3 AS is_filename FROM images"))
def filename_query(spark, d):
    """Suggestions that name a file and some that don't."""
    name, lang = F.col("source_file"), F.col("lang")
    forms = (F.concat(F.lit("Images from "), lang), F.concat(F.lit("pictures FROM "), name), F.concat(F.lit("charts from "), name), F.concat(F.lit("charts in "), name), F.concat(F.lit("people from above in "), lang))
    text = F.element_at(F.array(*forms), (F.col("image_id") % 5 + 1).cast("int"))
    return images(spark, d).select("image_id", T.filename_query(text).alias("is_filename"))


@query("f30_default_name", sql("images", r"SELECT image_id, regexp_replace(regexp_extract(source_file, '[^/]+$'), '\.[^.]+$', '') || CASE WHEN coalesce(slide_index, 0) <> 0 THEN ' slide ' || slide_index WHEN coalesce(page_index, 0) <> 0 THEN ' page ' || page_index ELSE '' END AS name FROM images"))
def default_name(spark, d):
    i = images(spark, d)
    return i.select("image_id", T.default_name(i.source_file, i.slide_index, i.page_index).alias("name"))


_NOTES = """, q AS (SELECT image_id, image_id % 3 * 20 AS p, image_id % 2 = 0 AS relaxed, image_id % 5 = 0 AS df, image_id % 7 = 0 AS sf, list_slice(tags, 1, 2) AS have, CASE WHEN image_id % 4 = 0 THEN aliases ELSE [] END AS avoid,
  CASE WHEN author IS NULL THEN ['No author was asked for.'] ELSE [] END AS notes FROM images)
SELECT image_id, list_concat(list_filter([
  CASE WHEN p > 0 THEN 'Showing matches at or above ' || p || '%.' END,
  CASE WHEN relaxed AND p > 0 THEN 'Fewer than ' || p || '% matches were available; including the closest matches to fill results.' END,
  CASE WHEN df AND sf THEN 'Dense and sparse retrieval both failed (check Bedrock / index).' WHEN df THEN 'Dense embedding search failed (check Bedrock embedding access).' WHEN sf THEN 'Sparse BM25 search failed (index may need re-ingest).' END,
  CASE WHEN len(have) > 0 THEN 'Must include: ' || array_to_string(have, ', ') || '.' END,
  CASE WHEN len(avoid) > 0 THEN 'Excluding: ' || array_to_string(avoid, ', ') || '.' END], lambda x: x IS NOT NULL), notes) AS notes FROM q"""


@query("f31_interpretation_notes", sql("images", _NOTES))
def interpretation_notes(spark, d):
    from ..operators.replies import interpretation_notes as notes_of

    i, none = F.col("image_id"), F.array().cast("array<string>")
    notes = notes_of(i % 3 * 20, i % 2 == 0, i % 5 == 0, i % 7 == 0, F.slice("tags", 1, 2), F.when(i % 4 == 0, F.col("aliases")).otherwise(none), F.when(F.col("author").isNull(), F.array(F.lit("No author was asked for."))).otherwise(none))
    return images(spark, d).select("image_id", notes.alias("notes"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`#>~]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("f32_conversation_search", f"WITH p AS (SELECT conv_id, turn, {_PLAIN} AS t FROM conversations), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, instr(lower(t), 'tion') AS pos FROM p WHERE contains(lower(t), 'tion')), s AS (SELECT *, greatest(0, least(greatest(0, pos - 1 - (72 - 4) // 2), length(t) - 72)) AS b FROM h WHERE n = 1) SELECT conv_id, turn, CASE WHEN b > 0 THEN '…' ELSE '' END || substring(t, CAST(b + 1 AS BIGINT), 72) || CASE WHEN b + 72 < length(t) THEN '…' ELSE '' END AS hit FROM s")
def conversation_search(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "conversations").select("conv_id", "turn", T.plain_markdown("text").alias("t")).where(F.contains(F.lower("t"), F.lit("tion")))
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n = 1")
    return first.select("conv_id", "turn", T.snippet(F.col("t"), F.lit("tion")).alias("hit"))


@query("f33_fence", "SELECT conv_id, turn, '<data>' || chr(10) || replace(coalesce(text, ''), '</data>', '<\\/data>') || chr(10) || '</data>' AS fenced FROM conversations")
def fence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.fenced("text").alias("fenced"))


@query("f35_best_caption", sql("images", ", r AS (SELECT image_id, coalesce(caption_quality, 'failed') AS before, (['ok', 'weak', 'failed'])[image_id % 3 + 1] AS again FROM images) SELECT image_id, CASE WHEN again = 'ok' OR (again = 'weak' AND before IN ('failed', 'weak')) THEN 'retry' ELSE 'first' END AS kept FROM r"))
def best_caption(spark, d):
    """The better of a caption and its retry."""
    before = F.coalesce("caption_quality", F.lit("failed"))
    again = F.element_at(F.array(F.lit("ok"), F.lit("weak"), F.lit("failed")), (F.col("image_id") % 3 + 1).cast("int"))
    return images(spark, d).select("image_id", F.when((again == "ok") | ((again == "weak") & before.isin("failed", "weak")), "retry").otherwise("first").alias("kept"))


@query("f36_spec_json", sql("images", """SELECT image_id, '{"author":"' || author || '","after":"' || strftime(modified_at, '%Y-%m-%d') || '"}' AS spec FROM images WHERE author IS NOT NULL AND modified_at IS NOT NULL"""))
def spec_json(spark, d):
    i = images(spark, d).where("author IS NOT NULL AND modified_at IS NOT NULL")
    return i.select("image_id", F.to_json(F.struct("author", F.date_format("modified_at", "yyyy-MM-dd").alias("after"))).alias("spec"))


@query("f37_display_caption", sql("images", "SELECT image_id, CASE WHEN image_id % 9 = 0 THEN 'Caption unavailable.' WHEN trim(caption_short) <> '' THEN caption_short ELSE caption_detailed END AS shown FROM images"))
def display_caption(spark, d):
    i = images(spark, d)
    short = F.when(i.image_id % 9 == 0, V.CAPTION_FAILED).otherwise(i.caption_short)
    return i.select("image_id", F.when(short == V.CAPTION_FAILED, "Caption unavailable.").when(F.trim(short) != "", short).otherwise(i.caption_detailed).alias("shown"))


@query("f38_preview", sql("images", "SELECT image_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS preview, CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '[truncated]' ELSE text END AS field FROM images"))
def preview(spark, d):
    return images(spark, d).select("image_id", T.preview("text", 40).alias("preview"), T.field_cut("text", 100).alias("field"))


@query("f39_record_caption", sql("images", _ASSET_SQL + r" SELECT i.image_id, regexp_replace(coalesce(scene, ''), '^\s+|\s+$', '', 'g') AS scene, canonical AS asset_type, regexp_replace(caption_short, '^\s+|\s+$', '', 'g') AS short_caption, coalesce(caption_quality, 'ok') AS quality FROM images i JOIN typed USING (image_id)"))
def record_caption(spark, d):
    c = F.struct(T.strip("scene").alias("scene"), T.asset_type("asset_type").alias("asset_type"), T.strip("caption_short").alias("short_caption"), F.coalesce("caption_quality", F.lit("ok")).alias("quality"))
    return images(spark, d).select("image_id", c.alias("c")).select("image_id", "c.*")


@query("v18_query_text", "SELECT turn, conv_id, array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), ' ') AS text FROM (SELECT conv_id, turn, list_filter([regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'Blue', 'blue', role, 'Role'], lambda x: x <> '') AS p FROM conversations)")
def query_text(spark, d):
    c = table(spark, d, "conversations")
    return c.select("turn", "conv_id", T.query_text(F.col("text"), F.lit(""), F.array(F.lit("Blue"), F.lit("blue"), F.col("role"), F.lit("Role"))).alias("text"))


@query("v19_pool_size", "SELECT conv_id, turn, CASE WHEN n <= 2 THEN 100 ELSE 50 END AS pool, greatest(CASE WHEN n <= 2 THEN 100 ELSE 50 END, 3 * 20) AS rerank_n FROM (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM conversations)")
def pool_size(spark, d):
    n = F.size(T.tokens(F.col("text")))
    base = F.when(n <= V.SHORT_TOKENS, V.SHORT_K).otherwise(V.DENSE_K)
    return table(spark, d, "conversations").select("conv_id", "turn", base.alias("pool"), F.greatest(base, F.lit(3 * 20)).alias("rerank_n"))
