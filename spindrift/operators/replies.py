"""Replies in words: what was found, how the query was read, what the corpus holds, how a run of cases went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Lengths that captions are cut to, results that a short reply lists, use cases and numbers that are named.
CAPTION, HIGHLIGHT, SHORT, USE_CASES, NUMBERS = 120, 100, 3, 5, 4
#: Sentences of replies.
NOTHING = "I couldn't find any images that match. Try loosening your filters or rephrasing your question."
NARROWED = "Narrowed from your previous search — "
KEEP_REFINING = 'You can keep refining (e.g. "only the charts" or "from last month").'
REFINE = 'You can refine with something like "only the charts" or "from last month."'


def interpretation_notes(min_percent: Column, relaxed: Column, dense_failed: Column, sparse_failed: Column, must_have: Column, must_avoid: Column, notes: Column) -> Column:
    """How a query was read, as sentences; what doesn't apply is left out."""
    percent = min_percent.cast("string")
    listed = lambda lead, words: F.when(F.size(words) > 0, F.concat(F.lit(lead), F.array_join(words, ", "), F.lit(".")))
    own = F.array(
        F.when(min_percent > 0, F.concat(F.lit("Showing matches at or above "), percent, F.lit("%."))),
        F.when(relaxed & (min_percent > 0), F.concat(F.lit("Fewer than "), percent, F.lit("% matches were available; including the closest matches to fill results."))),
        F.when(dense_failed & sparse_failed, "Dense and sparse retrieval both failed (check Bedrock / index).")
        .when(dense_failed, "Dense embedding search failed (check Bedrock embedding access).")
        .when(sparse_failed, "Sparse BM25 search failed (index may need re-ingest)."),
        listed("Must include: ", must_have),
        listed("Excluding: ", must_avoid),
    )
    return F.concat(F.array_compact(own), notes)


def _numbers(kind: str, values: Column) -> Column:
    """Up to four numbers, or two and how many more."""
    few = F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")
    many = F.concat(values[0].cast("string"), F.lit(", "), values[1].cast("string"), F.lit(", … and "), (F.size(values) - 2).cast("string"), F.lit(" more"))
    return F.concat(F.lit(f" ({kind} "), F.when(F.size(values) <= NUMBERS, few).otherwise(many), F.lit(")"))


def _joined(parts: Column) -> Column:
    """a; a and b; a, b, and c."""
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) == 1, parts[0]).when(F.size(parts) == 2, F.concat(parts[0], F.lit(" and "), parts[1])).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ", "), F.lit(", and "), last))


def location(kind: Column, slide: Column, page: Column, name: Column) -> Column:
    return F.when((kind == "pptx") & slide.isNotNull(), F.concat(F.lit("Slide "), slide.cast("string"))).when((kind == "pdf") & page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))).otherwise(name)


def answers(results: DataFrame) -> DataFrame:
    """(query_id, answer) of results (query_id, rank, image_name, source_file, source_type, slide_index, page_index, caption_short,
    caption_detailed, use_case, missing, refinement): a template reply. A query's results are a page of them, so one group is small.
    """
    caption = T.strip(F.coalesce(F.when(F.col("caption_short") != "", F.col("caption_short")), "caption_detailed", F.lit("")))
    detail = T.strip(T.text_or_empty("caption_detailed"))
    shown = F.when(caption == V.CAPTION_FAILED, F.when(detail.startswith(V.MODEL_ERROR), detail).otherwise("Caption unavailable (VLM failed during ingest).")).otherwise(caption)
    source = T.basename("source_file")
    rows = results.select(
        "query_id",
        "rank",
        F.when(source == "", "(unknown)").otherwise(source).alias("name"),
        F.when(~T.blank("image_name"), T.strip("image_name")).when(source != "", source).otherwise("(unknown)").alias("title"),
        "source_type",
        "slide_index",
        "page_index",
        shown.alias("caption"),
        T.strip(T.text_or_empty("use_case")).alias("use_case"),
        "missing",
        "refinement",
    ).withColumn("where", location(F.col("source_type"), F.col("slide_index"), F.col("page_index"), F.col("name")))
    paged = F.col("source_type").isin("pptx", "pdf")
    first = lambda c: F.min_by(c, "rank").alias(c)
    grouped = rows.withColumn("paged", paged).groupBy("query_id", "name").agg(F.count("*").alias("n"), first("title"), first("paged"), first("where"), F.sort_array(F.collect_set("slide_index")).alias("slides"), F.sort_array(F.collect_set("page_index")).alias("pages"))
    many = F.concat(F.col("n").cast("string"), F.lit(" from **"), "name", F.lit("**"))
    part = (
        F.when((F.col("n") == 1) & F.col("paged"), F.concat(F.lit("1 from **"), "title", F.lit("** ("), F.lower("where"), F.lit(")")))
        .when(F.col("n") == 1, F.concat(F.lit("1 standalone image (**"), "title", F.lit("**)")))
        .when(F.size("slides") > 0, F.concat(many, _numbers("slides", F.col("slides"))))
        .when(F.size("pages") > 0, F.concat(many, _numbers("pages", F.col("pages"))))
        .otherwise(many)
    )
    parts = grouped.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", part.alias("part")))).alias("parts"))
    line = F.concat(F.lit("• **"), "title", F.lit("**"), F.when(paged, F.concat(F.lit(" ("), "where", F.lit(")"))).otherwise(""), F.lit(" — "), F.when(F.col("caption") != "", T.truncated("caption", HIGHLIGHT)).otherwise("No caption"))
    page = rows.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("rank", F.when(F.col("caption") != "", T.truncated("caption", CAPTION)).otherwise("").alias("caption"), line.alias("line"), "use_case"))).alias("page"),
        F.sum(F.col("missing").cast("int")).alias("gone"),
        F.max("refinement").alias("refinement"),
    )
    n, count = F.col("n"), F.col("n").cast("string")
    prefix = F.when(F.col("refinement"), NARROWED).otherwise("")
    summary = _joined(F.col("parts.part"))
    hint = F.array_join(F.array_compact(F.array(F.when(n > SHORT, F.concat(F.lit("See all "), count, F.lit(" in the results panel."))), F.when(F.col("refinement"), KEEP_REFINING).otherwise(REFINE))), " ")
    captions = F.filter(F.transform("page", lambda p: p["caption"]), lambda c: c != "")
    found = F.concat(F.lit("I found "), count, F.when(n == 1, " image (").otherwise(" images ("), summary, F.lit(")"))
    short = F.concat(found, F.when(F.size(captions) > 0, F.concat(F.lit(": "), F.array_join(captions, "; "))).otherwise("."), F.lit(" "), hint)
    lines = F.array_join(F.transform(F.slice("page", 1, SHORT), lambda p: p["line"]), "\n")
    long = F.concat(F.lit("I found **"), count, F.lit("** images that match. "), summary, F.lit(".\n\n**Highlights:**\n"), lines, F.lit("\n\n"), hint)
    cases = F.slice(T.first_seen(F.filter(F.transform("page", lambda p: p["use_case"]), lambda c: c != "")), 1, USE_CASES)
    footer = F.when(F.size(cases) > 0, F.concat(F.lit("\n**Use cases:**\n"), F.array_join(F.transform(cases, lambda c: F.concat(F.lit("- "), c)), "\n"))).otherwise("")
    gone = F.when(F.col("gone") > 0, F.concat(F.lit("\n\n("), F.col("gone").cast("string"), F.when(F.col("gone") == 1, " result").otherwise(" results"), F.lit(" missing image files or blobs — re-ingest your source folder with `--force`.)"))).otherwise("")
    return page.join(parts, "query_id").select("query_id", T.strip(F.concat(prefix, F.when(n <= SHORT, short).otherwise(long), footer, gone)).alias("answer"))


#: How many entries each section of the corpus's description has, and the longest that is quoted.
SECTIONS = {"types": 3, "assets": 8, "tags": 12, "names": 8, "uses": 6, "aliases": 8, "captions": 12, "cases": 8, "sources": 8, "authors": 5}


def _counted(rows: DataFrame, limit: int) -> DataFrame:
    """(value, n, o) of rows (value, pos): the most frequent values; the one seen first comes first."""
    found = rows.where(F.col("value") != "").groupBy("value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = found.orderBy(F.col("n").desc(), "first").limit(limit)
    return top.withColumn("o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "first")))  # at most `limit` rows


def _sampled(rows: DataFrame, limit: int, longest: int | None) -> DataFrame:
    """(value, o) of rows (value, pos): the first distinct values, whatever their case."""
    kept = rows.where((F.col("value") != "") & (F.length("value") <= longest if longest else F.lit(True)))
    first = kept.groupBy(F.lower("value").alias("k")).agg(F.min(F.struct("pos", "value")).alias("f")).select("f.*")
    return first.orderBy("pos", "value").limit(limit).withColumn("o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos", "value")))


def corpus_context(images: DataFrame) -> DataFrame:
    """One row (context): what an index holds, in sections; those without entries are left out.

    `images` has image_name and use_case besides the catalogue's columns. Each section is a top-k of its own grouping, so no more
    than its few entries leave the executors.
    """
    at = F.struct(F.col("image_id").alias("a"), F.lit(0).alias("b"))
    plain = lambda value: images.select(T.strip(T.text_or_empty(value)).alias("value"), at.alias("pos"))
    spread = lambda column: images.select("image_id", F.posexplode(column).alias("p", "v")).select(T.strip(T.text_or_empty("v")).alias("value"), F.struct(F.col("image_id").alias("a"), F.col("p").alias("b")).alias("pos"))
    lowered = lambda rows: rows.withColumn("value", F.lower("value"))
    counted = F.concat("value", F.lit("="), F.col("n").cast("string"))
    kind = F.when(T.blank("source_type"), "image").otherwise(F.lower(T.text_or_empty("source_type")))
    caption = plain("caption_short").where(F.col("value") != V.CAPTION_FAILED)
    sources = images.select(T.basename("source_file").alias("value"), at.alias("pos"))
    kinds = images.groupBy(T.basename("source_file").alias("value")).agg(F.max_by(kind, "image_id").alias("kind"))

    def line(order: int, lead: str, rows: DataFrame, entry: Column) -> DataFrame:
        each = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("o", entry.alias("e")))).alias("s"))
        return each.where(F.size("s") > 0).select(F.lit(order).alias("k"), F.concat(F.lit(lead), F.array_join(F.col("s.e"), ", ")).alias("text"))

    def block(order: int, lead: str, rows: DataFrame, entry: Column) -> DataFrame:
        each = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("o", entry.alias("e")))).alias("s"))
        return each.where(F.size("s") > 0).select(F.lit(order).alias("k"), F.concat(F.lit(lead + "\n"), F.array_join(F.transform("s.e", lambda e: F.concat(F.lit("  - "), e)), "\n")).alias("text"))

    n = SECTIONS
    value = F.col("value")
    day = lambda of: F.coalesce(F.to_date(of("modified_at")).cast("string"), F.lit("?"))
    parts = [
        images.agg(F.lit(0).alias("k"), F.concat(F.lit("Indexed images: "), F.count("*").cast("string")).alias("text")),
        line(1, "File types: ", _counted(images.select(kind.alias("value"), at.alias("pos")), n["types"]), counted),
        line(2, "Asset types: ", _counted(lowered(plain("asset_type")), n["assets"]), counted),
        line(3, "Common tags: ", _counted(lowered(spread("tags")), n["tags"]), value),
        block(4, "Sample image names:", _sampled(plain("image_name"), n["names"], 120), value),
        block(5, "Sample use cases:", _sampled(plain("use_case"), n["uses"], 120), value),
        block(6, "Sample search aliases:", _sampled(spread("aliases"), n["aliases"], 80), value),
        block(7, "Sample captions:", _sampled(caption, n["captions"], 200), value),
        block(8, "Sample recommended search phrases:", _sampled(spread("cases"), n["cases"], None), value),
        block(9, "Top source files (grounding only — do not suggest filename-filter searches):", _counted(sources, n["sources"]).join(kinds, "value"), F.concat(value, F.lit(" ("), "kind", F.lit("): "), F.col("n").cast("string"))),
        line(10, "Authors: ", _counted(plain("author"), n["authors"]), value),
        images.agg(F.lit(11).alias("k"), F.concat(F.lit("Source modified date range: "), day(F.min), F.lit(" to "), day(F.max)).alias("text"), F.count("modified_at").alias("n")).where("n > 0").select("k", "text"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("context"))


def eval_line(label: str, macro: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row (line) of macro averages (cases, mrr, hit_k, recall_k)."""
    percent = lambda c: F.concat(F.bround(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))
    parts = [F.concat(F.lit(f"{label:<16} n="), F.col("cases").cast("string")), *(F.concat(F.lit(f"Hit@{k}="), percent(f"hit_{k}")) for k in ks)]
    parts += [F.concat(F.lit("MRR="), F.format_string("%.2f", "mrr")), F.concat(F.lit(f"Recall@{max(ks)}="), percent(f"recall_{max(ks)}"))]
    return macro.select(F.array_join(F.array(*parts), "  ").alias("line"))


def eval_cases(ranked: DataFrame, relevant: DataFrame, mode: str, k: int) -> DataFrame:
    """(case_id, failed, text): every case of a run, what it expected with its ranks and what it got; `failed` without a hit among the first k.

    `ranked`: (case_id, id, rank); `relevant`: (case_id, id, pos). A case's rows are as many as its right answers and its ranking.
    """
    expected = relevant.join(ranked, ["case_id", "id"], "left").groupBy("case_id").agg(
        F.coalesce(F.max(F.col("rank") <= k), F.lit(False)).alias("hit"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "rank"))), lambda x: F.concat(F.lit("  expected "), x["id"].cast("string"), F.lit("  rank="), F.coalesce(x["rank"].cast("string"), F.lit("—")))).alias("lines"),
    )
    got = ranked.where(F.col("rank") <= k).groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ", ").alias("got"))
    head = F.concat(F.when(F.col("hit"), "OK    ").otherwise("FAIL  "), F.col("case_id").cast("string"), F.lit(f" [{mode}]"))
    text = F.array_join(F.concat(F.array(head), "lines", F.when(F.col("got").isNotNull(), F.array(F.concat(F.lit("  got: "), "got"))).otherwise(F.array().cast("array<string>"))), "\n")
    return expected.join(got, "case_id", "left").select("case_id", (~F.col("hit")).alias("failed"), text.alias("text"))


def audit_report(distribution: DataFrame, signals: DataFrame, samples: bool = False) -> DataFrame:
    """One row (report): the table of asset types, confusions that occur, and warnings.

    `distribution`: (asset_type, n, percent) of the taxonomy and `unclassified`, `signals`: (signal, n, ids), both of a few rows.
    """
    order = {t: k for k, t in enumerate(V.ASSET_TYPES)}
    place = F.element_at(F.create_map(*(x for t, k in order.items() for x in (F.lit(t), F.lit(k)))), F.col("asset_type"))
    one = lambda c: F.bround(c, 1)
    rows = distribution.agg(
        F.sum("n").alias("total"),
        F.max(F.when(F.col("asset_type") == "unclassified", F.col("n"))).alias("none"),
        F.max(F.when(F.col("asset_type") == "other", F.col("n"))).alias("other"),
        F.sort_array(F.collect_list(F.when(F.col("asset_type") != "unclassified", F.struct(place.alias("k"), "asset_type", "n")))).alias("types"),
    )
    rules = F.create_map(*(x for name, told in V.CONFUSIONS.items() for x in (F.lit(name), F.lit(told))))
    place = F.element_at(F.create_map(*(x for k, name in enumerate(V.CONFUSIONS) for x in (F.lit(name), F.lit(k)))), F.col("signal"))
    found = signals.agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), "signal", "n", "ids", rules[F.col("signal")].alias("told")))).alias("signals"))
    t = rows.join(F.broadcast(found))  # one row each
    share = lambda n: F.when(F.col("total") > 0, 100.0 * n / F.col("total")).otherwise(0.0)
    line = lambda x: F.format_string("  %-14s %5d  (%5.1f%%)", x["asset_type"], x["n"], one(share(x["n"])))
    none = F.array().cast("array<string>")

    def signal(x):
        head = F.array(F.concat(F.lit("  "), x["signal"], F.lit(": "), x["n"].cast("string")))
        if not samples:
            return head
        ids = F.array_join(F.transform(x["ids"], lambda i: i.cast("string")), ", ")
        return F.concat(head, F.when(F.size(x["ids"]) > 0, F.array(F.concat(F.lit("    samples: "), ids))).otherwise(none))

    warned = F.concat(
        F.when(F.col("none") > 0, F.array(F.format_string("  WARN: %d row(s) (%.1f%%) lack asset_type", "none", one(share(F.col("none")))))).otherwise(none),
        F.when(share(F.col("other")) >= V.OTHER_WARNED, F.array(F.format_string(f"  WARN: other is %.1f%% (threshold {V.OTHER_WARNED:.0f}%%)", one(share(F.col("other")))))).otherwise(none),
        F.transform(F.filter("signals", lambda x: x["n"] >= V.CONFUSED_WARNED), lambda x: F.format_string("  WARN: %s — %d cases (%s)", x["signal"], x["n"], x["told"])),
    )
    lines = F.concat(
        F.array(F.lit(f"Asset type audit (taxonomy v{V.TAXONOMY})"), F.format_string("Total records: %d", "total"), F.format_string("Unclassified: %d (%.1f%%)", "none", one(share(F.col("none")))), F.lit(""), F.lit("Distribution:")),
        F.transform("types", line),
        F.when(F.size("signals") > 0, F.concat(F.array(F.lit(""), F.lit("Confusion signals (heuristic):")), F.flatten(F.transform("signals", signal)))).otherwise(none),
        F.when(F.size(warned) > 0, F.concat(F.array(F.lit(""), F.lit("Warnings:")), warned)).otherwise(none),
    )
    return t.select(F.array_join(lines, "\n").alias("report"))
