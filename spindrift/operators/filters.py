"""Filters and projections of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


@dataclass
class Filters:
    """What a query asks of metadata; empty fields ask nothing."""

    file_types: list[str] = field(default_factory=list)
    asset_types: list[str] = field(default_factory=list)
    filename_contains: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    after: str | None = None
    before: str | None = None

    def any(self) -> bool:
        return bool(self.file_types or self.asset_types or self.filename_contains or self.authors or self.after or self.before)


def metadata_filter(images: DataFrame, f: Filters) -> DataFrame:
    """All conditions at once; rows without an asset type or date never meet a condition on it."""
    out = images
    if f.file_types:
        out = out.where(F.lower("source_type").isin(*[t.lower() for t in f.file_types]))
    if f.asset_types:
        out = out.where(~T.blank("asset_type") & T.asset_type("asset_type").isin(*f.asset_types))
    if f.filename_contains:
        name = F.lower(T.basename("source_file"))
        out = out.where(_any(F.contains(name, F.lit(x.lower())) for x in f.filename_contains))
    if f.authors:
        out = out.where(_any(F.contains(F.lower(T.text_or_empty("author")), F.lit(x.lower())) for x in f.authors))
    if f.after:
        out = out.where(F.col("modified_at") >= F.lit(f.after).cast("timestamp"))
    if f.before:
        out = out.where(F.col("modified_at") <= F.lit(f.before).cast("timestamp"))
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def allowed(images: DataFrame, f: Filters, restrict_to: list[int] | None = None) -> DataFrame | None:
    """The ids that may be searched: None is the whole index, an empty table no match; an empty `restrict_to` is no filter."""
    if not f.any() and not restrict_to:
        return None
    out = metadata_filter(images, f)
    if restrict_to:
        out = out.where(F.col("image_id").isin(*restrict_to))
    return out.select("image_id")


def avoids(images: DataFrame, terms: list[str]) -> DataFrame:
    """Rows none of whose texts hold a term."""
    blob = F.lower(F.concat_ws(" ", "caption_short", "caption_detailed", "scene", "source_file", F.array_join("tags", " ")))
    return images.where(~_any(F.contains(blob, F.lit(t.lower())) for t in terms if t.strip()))


def search_flags(searches: DataFrame, interacted: DataFrame, weak: float = V.WEAK_SCORE) -> DataFrame:
    """Searches with `zero`, `weak` and `no_interaction`; `interacted`: (id)."""
    hit = interacted.select(F.col("id").alias("_id")).distinct()
    with_flag = searches.join(hit, searches.id == hit._id, "left")
    some = F.col("result_count") > 0
    return with_flag.select(*searches.columns, (F.col("result_count") == 0).alias("zero"), (some & F.coalesce(F.col("top_score") < weak, F.lit(False))).alias("weak"), (some & F.col("_id").isNull()).alias("no_interaction"))


def unclassified_rate(images: DataFrame) -> DataFrame:
    return images.agg(F.coalesce(1.0 - F.avg((F.coalesce("asset_type", F.lit("")) != "").cast("double")), F.lit(1.0)).alias("rate"))


def quality_filter(images: DataFrame, quality: str) -> DataFrame:
    if quality not in ("all", "ok", "weak", "failed"):
        raise ValueError(f"unknown caption quality: {quality}")
    return images if quality == "all" else images.where(F.coalesce(F.lower("caption_quality"), F.lit("ok")) == quality)


def recoverability(images: DataFrame, blobs: DataFrame, sources: DataFrame) -> DataFrame:
    """How an image can be shown: `display` from its own blob, `source` from an image file it came from, else `unrecoverable`."""
    b = blobs.select(F.col("image_id").alias("_b")).distinct()
    s = sources.select(F.col("source_file").alias("_s")).distinct()
    j = images.join(b, images.image_id == b._b, "left").join(s, images.source_file == s._s, "left")
    state = F.when(F.col("_b").isNotNull(), "display").when(F.col("_s").isNotNull() & (F.col("source_type") == "image"), "source").otherwise("unrecoverable")
    return j.select(*images.columns, state.alias("recoverable"))


def too_new(listing: DataFrame, now: Column, hours: float) -> DataFrame:
    """Listed objects with `too_new`; an unknown age is old enough."""
    return listing.withColumn("too_new", F.coalesce(F.col("last_modified") > now - F.make_interval(hours=F.lit(int(hours))), F.lit(False)))
