"""String, date, array and JSON functions of the catalogue, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def blank(c: Column | str) -> Column:
    return strip(text_or_empty(c)) == ""


def normalize_tag(c: Column | str) -> Column:
    """Lower case, single blanks, singular."""
    t = F.regexp_replace(F.lower(strip(text_or_empty(c))), r"(?U)\s+", " ")
    size = F.length(t)
    y = F.concat(F.substring(t, F.lit(1), size - 3), F.lit("y"))
    ies = t.endswith("ies") & (size > 4)
    s = t.endswith("s") & (size > 3) & ~t.endswith("ss") & ~t.isin(*V.PLURAL_EXCEPTIONS)
    return F.when(ies, F.when(y.isin(*V.PLURAL_EXCEPTIONS), t).otherwise(y)).when(s, F.substring(t, F.lit(1), size - 1)).otherwise(t)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0))


def index_tokens(c: Column | str) -> Column:
    """Runs of ASCII letters, digits and _, in lower case: other letters split words."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def asset_type(c: Column | str) -> Column:
    """The taxonomy's name for a label: itself, a synonym, the longest synonym that it holds, or `other`."""
    key = F.replace(F.lower(strip(text_or_empty(c))), F.lit("_"), F.lit(" "))
    exact = F.when(key.isin(*V.ASSET_TYPES), key)
    longest = sorted(V.ASSET_SYNONYMS, key=lambda s: -len(s))
    inside = reduce(lambda chain, s: chain.when(F.contains(key, F.lit(s)), F.lit(V.ASSET_SYNONYMS[s])), longest[1:], F.when(F.contains(key, F.lit(longest[0])), F.lit(V.ASSET_SYNONYMS[longest[0]])))
    return F.coalesce(exact, F.try_element_at(_map(V.ASSET_SYNONYMS), key), inside, F.lit("other"))


def query_asset_type(c: Column | str) -> Column:
    """The asset type that a query's word names, if any."""
    key = normalize_tag(c)
    return F.when(key.isin(*V.ASSET_TYPES), key).otherwise(F.try_element_at(_map(V.ASSET_SYNONYMS), key))


def asset_label(c: Column | str) -> Column:
    return F.when(blank(c), F.lit("")).otherwise(F.initcap(asset_type(c)))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(c), "/+$", ""), "/"), -1)


def safe_filename(c: Column | str) -> Column:
    """Letters, digits, dot, dash and underscore; anything else becomes one underscore; `upload` if nothing is left."""
    name = F.regexp_replace(basename(text_or_empty(c)), r"[^A-Za-z0-9._-]+", "_")
    name = F.regexp_replace(name, r"^[._]+|[._]+$", "")
    return F.when(name == "", F.lit("upload")).otherwise(name)


def truncated(c: Column | str, limit: int) -> Column:
    """Stripped, and cut with three dots if longer than the limit."""
    t = strip(text_or_empty(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit - 3)), r"(?U)\s+$", ""), F.lit("...")))


def preview(c: Column | str, limit: int) -> Column:
    t = text_or_empty(c)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 3)), F.lit("..."))).otherwise(t)


def field_cut(c: Column | str, limit: int, marker: str = "\n[truncated]") -> Column:
    t = text_or_empty(c)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(marker))).otherwise(t)


def provenance(source_type: Column, slide: Column, page: Column, source_file: Column, modified: Column, author: Column) -> Column:
    name = F.coalesce(F.when(text_or_empty(source_file) == "", F.lit(None)).otherwise(basename(source_file)), F.lit("(unknown)"))
    where = F.when((source_type == "pptx") & (F.coalesce(slide, F.lit(0)) != 0), F.concat(F.lit("Slide "), slide.cast("string"), F.lit(" of "), name)).when(
        (source_type == "pdf") & (F.coalesce(page, F.lit(0)) != 0), F.concat(F.lit("Page "), page.cast("string"), F.lit(" of "), name)
    ).otherwise(name)
    when = F.when(modified.isNotNull(), F.concat(F.lit(", modified "), F.date_format(modified, "yyyy-MM-dd"))).otherwise("")
    by = F.when(text_or_empty(author) != "", F.concat(F.lit(", by "), author)).otherwise("")
    return F.concat(where, when, by)


def joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't null or empty; arrays give each of theirs."""
    flat = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return F.array_join(F.filter(flat, lambda p: p != ""), separator)


def one(c: Column | str) -> Column:
    """A text as an array of one, or of none."""
    t = text_or_empty(c)
    return F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def labelled(label: str, items: Column, separator: str, limit: int | None = None) -> Column:
    items = F.coalesce(items, F.array().cast("array<string>"))
    items = F.slice(items, 1, limit) if limit else items
    return F.when(F.size(items) > 0, F.array(F.concat(F.lit(label), F.array_join(items, separator)))).otherwise(F.array().cast("array<string>"))


def first_seen(items: Column, key=F.lower) -> Column:
    """Distinct items by key, the first of each, in order: a fold over the array."""
    empty = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        new = ~F.array_contains(s["keys"], key(x))
        return F.struct(F.when(new, F.array_append(s["keys"], key(x))).otherwise(s["keys"]).alias("keys"), F.when(new, F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(items, empty, step, lambda s: s["kept"])


def search_terms(items: Column, limit: int, drop_types: bool = False) -> Column:
    """Stripped, lower-case, distinct terms in order, at most `limit`; with `drop_types`, no bare names of asset types."""
    low = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != "")
    if drop_types:
        low = F.filter(low, lambda x: ~x.isin(*V.ASSET_TYPES))
    return F.slice(F.array_distinct(low), 1, limit)


def json_list(c: Column | str) -> Column:
    """A JSON list of strings; anything else is an empty one."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def lenient_json(c: Column | str) -> Column:
    """The JSON text inside an answer: without code fences, or what stands between the first and the last brace."""
    bare = F.regexp_replace(strip(text_or_empty(c)), r"^```(?:json)?\s*|\s*```$", "")
    inside = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(inside == "", F.lit(None)).otherwise(inside)


def lenient_date(c: Column | str) -> Column:
    t = strip(text_or_empty(c))
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in forms))


def pdf_date(c: Column | str) -> Column:
    """A PDF's date: 14 digits after `D:` as a time, else 8 as a day; a bad one is null."""
    t = F.regexp_replace(text_or_empty(c), "^D:", "")
    long = F.try_to_timestamp(F.when(F.left(t, F.lit(14)).rlike("^[0-9]{14}$"), F.left(t, F.lit(14))), F.lit("yyyyMMddHHmmss"))
    short = F.try_to_timestamp(F.when(F.left(t, F.lit(8)).rlike("^[0-9]{8}$"), F.left(t, F.lit(8))), F.lit("yyyyMMdd"))
    return F.when(F.length(t) >= 14, long).when(F.length(t) >= 8, short)


def slide_text(c: Column | str) -> Column:
    """Line ends as LF, lines stripped, at most one empty line in a row."""
    t = F.regexp_replace(text_or_empty(c), "\r\n?", "\n")
    t = F.array_join(F.transform(F.split(t, "\n"), strip), "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def digest(c: Column, size: int = 64) -> Column:
    return F.left(F.sha2(c, 256), F.lit(size))


def match_percent(raw: Column, kind: Column) -> Column:
    """Display percentage of a score: linear between anchors, half to even."""
    x = F.greatest(F.lit(0.0), F.least(raw.cast("double"), F.lit(1.0)))

    def chain(anchors) -> Column:
        out = F.when(x <= anchors[0][0], F.lit(float(anchors[0][1])))
        for (r0, d0), (r1, d1) in zip(anchors, anchors[1:]):
            out = out.when(x <= r1, F.lit(float(d0)) + (x - r0) / (r1 - r0) * (d1 - d0))
        return F.bround(out.otherwise(float(anchors[-1][1])), 0)

    out = F.when(kind == "rerank", chain(V.MATCH_ANCHORS["rerank"])).when(kind == "dense", chain(V.MATCH_ANCHORS["dense"])).otherwise(chain(V.MATCH_ANCHORS["fusion"]))
    return F.greatest(F.lit(0), F.least(F.lit(100), out.cast("int")))


def filename_query(c: Column | str) -> Column:
    """Whether a suggested query names a file."""
    t = strip(text_or_empty(c))
    return t.rlike("(?iu)" + V.FILENAME_LEAD) | (t.rlike("(?iu)" + V.FILENAME_EXTENSION) & t.rlike(r"(?iu)\bfrom\b"))


def explicit_asset(c: Column | str) -> Column:
    return text_or_empty(c).rlike("(?iu)" + V.EXPLICIT_ASSET)


def explicit_file(c: Column | str) -> Column:
    return text_or_empty(c).rlike("(?iu)" + V.EXPLICIT_FILE)


def file_types(items: Column) -> Column:
    """Names of file types as pptx, pdf or image; others fall away."""
    named = F.transform(items, lambda x: F.regexp_replace(strip(F.lower(x)), r"^\.+", ""))
    named = F.transform(named, lambda x: F.when(x.isin(*V.IMAGE_EXTENSIONS), F.lit("image")).otherwise(x))
    return F.array_distinct(F.filter(named, lambda x: x.isin(*V.FILE_TYPES)))


def caption_reasons(name: Column, short: Column, detailed: Column, scene: Column, objects: Column, readable: Column, uncertain: Column, tags: Column, cases: Column, aliases: Column) -> Column:
    """Why a caption is weak, in order; one reason `caption_failed_marker` for a failed one."""
    short_, detailed_ = strip(text_or_empty(short)), strip(text_or_empty(detailed))
    filled = lambda a: F.size(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: ~blank(x)))
    words = F.size(F.filter(F.split(short_, r"(?U)\s+"), lambda w: w != ""))
    no_objects = filled(objects) == 0
    checks = (
        (blank(name), "missing_image_name"),
        (short_ == "", "missing_short_caption"),
        ((short_ != "") & ((F.length(short_) < 15) | (words < 4)), "short_caption_too_brief"),
        (detailed_ == "", "missing_detailed_description"),
        (short_.rlike("(?iu)" + "|".join(V.GENERIC_OPENERS)), "generic_caption_opener"),
        (blank(scene) & no_objects, "missing_scene_and_objects"),
        (F.coalesce(uncertain, F.lit(False)) & ~blank(readable) & no_objects, "uncertain_text_without_objects"),
        (filled(tags) < 3, "insufficient_tags"),
        (filled(cases) < 3, "insufficient_recommended_cases"),
        (filled(aliases) < 2, "insufficient_aliases"),
    )
    weak = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))
    failed = (short_ == V.CAPTION_FAILED) | detailed_.startswith(V.MODEL_ERROR)
    return F.when(failed, F.array(F.lit("caption_failed_marker"))).otherwise(weak)


def caption_quality(reasons: Column) -> Column:
    return F.when(F.array_contains(reasons, "caption_failed_marker"), "failed").when(F.size(reasons) > 0, "weak").otherwise("ok")


def default_name(source_file: Column, slide: Column, page: Column) -> Column:
    stem = F.regexp_replace(basename(source_file), r"\.[^.]+$", "")
    return F.concat(stem, F.when(F.coalesce(slide, F.lit(0)) != 0, F.concat(F.lit(" slide "), slide.cast("string"))).when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" page "), page.cast("string"))).otherwise(""))


def fenced(c: Column | str, tag: str = "data") -> Column:
    """A text inside a fence that it cannot close."""
    return F.concat(F.lit(f"<{tag}>\n"), F.replace(text_or_empty(c), F.lit(f"</{tag}>"), F.lit(f"<\\/{tag}>")), F.lit(f"\n</{tag}>"))


def plain_markdown(c: Column | str) -> Column:
    """Without emphasis, code marks, headings and link targets, on one line."""
    t = F.regexp_replace(text_or_empty(c), r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"[*_`#>~]", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def snippet(c: Column, needle: Column, width: int = 72) -> Column:
    """At most `width` characters around the needle's first place, with dots where text is left out."""
    at = F.instr(F.lower(c), F.lower(needle))
    start = F.greatest(F.lit(0), (at - 1 - F.floor((F.lit(width) - F.length(needle)) / 2)).cast("int"))
    start = F.greatest(F.lit(0), F.least(start, F.length(c) - width))
    body = F.substring(c, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(c), "…").otherwise(""))


def query_text(semantic: Column, raw: Column, must_have: Column) -> Column:
    """The words that are embedded: the query and what must be there, each once."""
    base = F.when(blank(semantic), raw).otherwise(semantic)
    parts = F.filter(F.transform(F.concat(F.array(text_or_empty(base)), F.coalesce(must_have, F.array().cast("array<string>"))), strip), lambda p: p != "")
    return F.array_join(first_seen(parts), " ")


def query_tokens(semantic: Column, raw: Column, must_have: Column) -> Column:
    return F.size(tokens(F.when(blank(semantic), raw).otherwise(semantic))) + F.size(F.coalesce(must_have, F.array().cast("array<string>")))
