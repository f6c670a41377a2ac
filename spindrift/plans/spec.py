"""Parsed queries: defaults, clamps and the removal of filters that nobody asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def spec_of(raw: DataFrame, limit: int = 50) -> DataFrame:
    """Rows (semantic_query, top_k, file_types, raw_text ...) as complete specs."""
    none = F.array().cast("array<string>")
    return raw.select(
        F.when(T.blank("semantic_query"), F.col("raw_text")).otherwise(T.strip("semantic_query")).alias("semantic_query"),
        F.greatest(F.lit(1), F.least(F.coalesce("top_k", F.lit(V.TOP_K)), F.lit(limit))).alias("top_k"),
        T.file_types(F.coalesce("file_types", none)).alias("file_types"),
        *[c for c in raw.columns if c not in ("semantic_query", "top_k", "file_types")],
    )


def sanitised(specs: DataFrame, images: DataFrame, covered: DataFrame) -> DataFrame:
    """Specs (raw_text, asset_types, file_types) without inferred filters, and `notes` why.

    An asset-type filter stays if the text asks for one and enough of the corpus is classified; a file-type filter stays if the
    text asks for one and some indexed image (`covered`: source_type) has such a type.
    """
    rate = images.agg(F.coalesce(1.0 - F.avg((F.coalesce("asset_type", F.lit("")) != "").cast("double")), F.lit(1.0)).alias("_rate"))
    types = covered.select("source_type").distinct().agg(F.collect_set("source_type").alias("_covered"))
    s = specs.join(F.broadcast(rate)).join(F.broadcast(types))  # one row each
    asset = F.when(F.size("asset_types") == 0, F.lit(None)).when(~T.explicit_asset("raw_text"), "asset type was not asked for").when(F.col("_rate") >= V.UNCLASSIFIED_LIMIT, "asset types are not populated enough")
    file = F.when(F.size("file_types") == 0, F.lit(None)).when(~T.explicit_file("raw_text"), "file type was not asked for").when(~F.arrays_overlap("file_types", "_covered"), "no indexed images of these file types")
    none = F.array().cast("array<string>")
    out = s.withColumn("notes", F.array_compact(F.array(asset, file)))
    return out.withColumn("asset_types", F.when(asset.isNull(), F.col("asset_types")).otherwise(none)).withColumn("file_types", F.when(file.isNull(), F.col("file_types")).otherwise(none)).drop("_rate", "_covered")
