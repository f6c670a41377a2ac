"""States that follow from the order of events: sessions of questions, and caches whose entries expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def states(events: DataFrame) -> DataFrame:
    """(id, era, turns, last_spec, last_results, refines) after each of the events (id, session, at, kind, results).

    `reset` begins an era without history; `ask` adds a turn, which refines what the era has; `similar` is a new anchor. The last
    search and its first results are the context of the next question. Running counts in one pass over each session.
    """
    order = Window.partitionBy("session").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    eras = events.withColumn("era", F.count(F.when(F.col("kind") == "reset", 1)).over(order))
    own = Window.partitionBy("session", "era").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    reset = F.col("kind") == "reset"
    before = F.count(F.when(~reset, 1)).over(own)
    return eras.select(
        "id",
        "era",
        F.count(F.when(F.col("kind") == "ask", 1)).over(own).alias("turns"),
        F.when(~reset, F.col("id")).alias("last_spec"),
        F.when(reset, F.array().cast("array<bigint>")).otherwise(F.col("results")).alias("last_results"),
        ((F.col("kind") == "ask") & (before > 1)).alias("refines"),
    )


def ttl_lookups(events: DataFrame, seconds: int) -> DataFrame:
    """(id, hit, version) of the lookups among events (key, at, id, stores): whether the newest entry before it is young enough.

    Entries and lookups are one ordered stream per key, so no lookup is joined with ranges of entries. `version` counts the
    entries that the key has had: a value computed for an older one is stale.
    """
    order = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    stored = F.max(F.when(F.col("stores"), F.unix_micros("at"))).over(order)
    seen = events.withColumn("stored", stored).withColumn("version", F.count(F.when(F.col("stores"), 1)).over(order))
    hit = F.coalesce(F.unix_micros("at") - F.col("stored") <= seconds * 1_000_000, F.lit(False))
    return seen.where(~F.col("stores")).select("id", hit.alias("hit"), "version")
