"""Suggested queries and template answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .ordering import numbered


def pool(seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(text, rank) of seeds (tier, pos, text): the first of each, whatever its case, without those that name files."""
    clean = seeds.select("tier", "pos", T.strip(T.text_or_empty("text")).alias("text")).where((F.col("text") != "") & ~T.filename_query("text"))
    first = clean.groupBy(F.lower("text").alias("key")).agg(F.min(F.struct("tier", "pos", "text")).alias("s"))
    order = (F.col("tier").cast("long") * 2**56 + F.col("pos")).alias("order")
    picked = first.select("s.*").select("text", order)
    if not limit:
        return numbered(picked, ["order", "text"], "rank").select("text", "rank")
    return picked.orderBy("order", "text").limit(limit).select("text", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order", "text")).alias("rank"))


#: Results that follow-ups are drawn from, and what is offered besides.
RESULTS, SHORT = 5, 60
CHARTS, BROADEN = "only charts and diagrams", "broaden the search"


def follow_ups(results: DataFrame, specs: DataFrame, top_author: DataFrame, pool_: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, suggestions): what may be asked next, first from the results, then as refinements, then from the corpus's pool.

    `results`: (query_id, rank, cases, tags, caption_short); `specs`: (query_id, text, semantic_query, asset_types, authors,
    is_refinement); `top_author`: at most one row (author); `pool_`: (text, rank). A suggestion that names a file, repeats another or
    the query itself, whatever its case, is left out.
    """
    caption = T.strip(T.text_or_empty("caption_short"))
    short = F.when(F.length(caption) <= SHORT, caption).otherwise(F.concat(F.left(caption, F.lit(SHORT - 3)), F.lit("...")))
    own = F.concat("cases", F.transform("tags", lambda t: F.concat(t, F.lit(" and related visuals"))), F.when((caption != "") & (caption != V.CAPTION_FAILED), F.array(short)).otherwise(F.array().cast("array<string>")))
    found = results.where(F.col("rank") <= RESULTS).select("query_id", "rank", F.posexplode(own).alias("p", "text")).select("query_id", F.lit(0).alias("tier"), (F.col("rank") * 1000 + F.col("p")).cast("long").alias("pos"), "text")
    author = top_author.agg(F.max("author").alias("author"))  # one row
    refine = F.array_compact(
        F.array(
            F.when(F.size("asset_types") == 0, CHARTS),
            F.when((F.size("authors") == 0) & F.col("author").isNotNull(), F.concat(F.lit("by "), "author")),
            F.when(F.col("is_refinement"), BROADEN).when(F.col("semantic_query") != "", F.concat(F.lit("more like "), "semantic_query")),
        )
    )
    offered = specs.join(F.broadcast(author)).select("query_id", F.posexplode(refine).alias("p", "text")).select("query_id", F.lit(1), F.col("p").cast("long"), "text")
    # of the pool, what is left if all other suggestions and both forms of the query were in it too
    rest = pool_.where(F.col("rank") <= 2 * limit + 2).select("text", F.col("rank").cast("long").alias("rank"))
    general = specs.select("query_id").join(F.broadcast(rest)).select("query_id", F.lit(2), "rank", "text")
    every = found.union(offered).union(general).withColumn("text", T.strip(T.text_or_empty("text"))).where((F.col("text") != "") & ~T.filename_query("text"))
    asked = specs.select("query_id", F.lower(T.strip("text")).alias("a"), F.lower(T.strip("semantic_query")).alias("b"))
    keyed = every.withColumn("key", F.lower("text")).join(asked, "query_id").where((F.col("key") != F.coalesce("a", F.lit(""))) & (F.col("key") != F.coalesce("b", F.lit(""))))
    first = keyed.groupBy("query_id", "key").agg(F.min(F.struct("tier", "pos", "text")).alias("s"))
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("s"))).where(F.col("n") <= limit)
    return best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["text"]).alias("suggestions"))
