"""The catalogue's logical tables as views of the driver's tables, for Spark and, word for word, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labels of assets as people write them, one per remainder of doc_id by 12; None stands for a missing one.
RAW_TYPES = ("photo", "Bar Chart", "flow_chart", "screenshots", "", "quarterly bar chart slide", None, " Logo ", "unknown thing", "icon", "TABLE", "geographic map")
EPOCH = 1704067200


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image: documents with labels, and catalogue columns made from them."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("pptx"), F.lit("pdf"), F.lit("image")), (i % 3 + 1).cast("int"))
    raw = F.element_at(F.array(*map(F.lit, RAW_TYPES)), (i % 12 + 1).cast("int"))
    words = F.split("text", " ")
    created = F.timestamp_seconds(F.lit(EPOCH) + i % 500 * 3600)
    return d.select(
        i.alias("image_id"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
        kind.alias("source_type"),
        F.concat(F.lit("corpus/"), "lang", F.lit("/"), "source", F.lit("-deck."), F.when(kind == "image", "png").otherwise(kind)).alias("source_file"),
        "source",
        "lang",
        F.when(i % 5 != 0, F.concat(F.lit("Author "), (i % 4).cast("string"))).alias("author"),
        F.when(kind == "pptx", i % 40).alias("slide_index"),
        F.when(kind == "pdf", i % 25).alias("page_index"),
        created.alias("created_at"),
        F.when(i % 6 != 0, created - F.expr("INTERVAL 3 DAYS")).alias("modified_at"),
        raw.alias("asset_type"),
        F.left("text", F.lit(60)).alias("caption_short"),
        F.expr("substring(text, 61)").alias("caption_detailed"),
        F.when(i % 4 != 0, F.left("text", F.lit(20))).otherwise("").alias("scene"),
        F.slice(words, 1, 6).alias("tags"),
        F.slice(words, 7, 4).alias("aliases"),
        F.slice(words, 11, 3).alias("cases"),
        F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "weak").alias("caption_quality"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
    )


_RAW = ", ".join("NULL" if x is None else f"'{x}'" for x in RAW_TYPES)
CTE = {
    "images": f"""
  SELECT doc_id AS image_id, text, sha256(text) AS content_hash,
    (['pptx', 'pdf', 'image'])[doc_id % 3 + 1] AS source_type,
    'corpus/' || lang || '/' || source || '-deck.' || (['pptx', 'pdf', 'png'])[doc_id % 3 + 1] AS source_file, source, lang,
    CASE WHEN doc_id % 5 <> 0 THEN 'Author ' || (doc_id % 4) END AS author,
    CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 END AS slide_index,
    CASE WHEN doc_id % 3 = 1 THEN doc_id % 25 END AS page_index,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 500 AS INTEGER)) AS created_at,
    CASE WHEN doc_id % 6 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 500 AS INTEGER)) - INTERVAL 3 DAYS END AS modified_at,
    ([{_RAW}])[doc_id % 12 + 1] AS asset_type,
    left(text, 60) AS caption_short, substring(text, 61) AS caption_detailed,
    CASE WHEN doc_id % 4 <> 0 THEN left(text, 20) ELSE '' END AS scene,
    list_slice(string_split(text, ' '), 1, 6) AS tags, list_slice(string_split(text, ' '), 7, 10) AS aliases, list_slice(string_split(text, ' '), 11, 13) AS cases,
    CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'weak' END AS caption_quality, coalesce(toxic, 0) = 1 AS deleted
  FROM documents LEFT JOIN labels USING (doc_id)""",
    "vectors": "SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings",
    "searches": """
  SELECT event_id AS id, ts AS created_at, event_type AS search_kind, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS result_count, least(1.0, value / 100.0) AS top_score
  FROM events WHERE event_type <> 'click'""",
    "interactions": "SELECT event_id AS id, event_id - 1 AS search_event_id, ts AS created_at, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS image_id FROM events WHERE event_type = 'click'",
}


def sql(views: str, body: str) -> str:
    """SQL over views named with blanks between; `body` is a SELECT, or begins with further views after a comma."""
    return "WITH " + ", ".join(f"{v} AS ({CTE[v]})" for v in views.split()) + "\n" + body


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"), "label")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type <> 'click'")
    return e.select(F.col("event_id").alias("id"), "created_at", F.col("event_type").alias("search_kind"), "user_id", "k", (F.col("k") % 10).alias("result_count"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("top_score"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'click'")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") - 1).alias("search_event_id"), "created_at", "user_id", F.col("k").alias("image_id"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where("not deleted")
