"""Decks: what a run can take from the last one, by fingerprints of slides and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(slides: DataFrame) -> DataFrame:
    """(deck_id, slides, request): the manifest's keys of slides (deck_id, slide, text, request)."""
    each = F.struct("slide", F.sha2("text", 256).alias("hash"))
    decks = slides.groupBy("deck_id").agg(F.sort_array(F.collect_list(each)).alias("s"), F.max("request").alias("request"))
    return decks.select("deck_id", F.sha2(F.array_join(F.col("s.hash"), "\n"), 256).alias("slides"), F.sha2("request", 256).alias("request"))


def plan(slides: DataFrame, manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """(deck_id, plan, to_describe): `manifest` where all is as before, `search` where only the request differs, else `describe+search`.

    `manifest`: (deck_id, slides, request) of the last run; `cache`: (hash) of slides that have a description; `to_describe` counts
    the deck's slides that have none.
    """
    before = manifest.select("deck_id", F.col("slides").alias("_s"), F.col("request").alias("_r"))
    state = fingerprints(slides).join(before, "deck_id", "left")
    same = F.coalesce(F.col("slides") == F.col("_s"), F.lit(False))
    todo = slides.select("deck_id", F.sha2("text", 256).alias("hash")).join(cache.select("hash").distinct(), "hash", "left_anti").groupBy("deck_id").agg(F.count("*").alias("n"))
    what = F.when(same & (F.col("request") == F.col("_r")), "manifest").when(same, "search").otherwise("describe+search")
    return state.select("deck_id", what.alias("plan")).join(todo, "deck_id", "left").select("deck_id", "plan", F.coalesce("n", F.lit(0)).cast("long").alias("to_describe"))
