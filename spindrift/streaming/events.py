"""Streams of telemetry: incremental roll-ups, validation and retention."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import values as V

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string, version long"

#: Ids that share a row of state: those issued one after another arrive together.
SPAN = 64
_KEPT = "last string"
_CHANGES = "dt string, event_type string, n long, k long"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events as their files arrive in a folder; files without a version hold the first one."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _order(row: list) -> tuple:
    """Versions by number, then time, then content, so that the order of arrival doesn't matter."""
    version, at, _, kind, k = row
    return version, at, kind is not None, kind or "", k is not None, k or 0


def _changed(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a batch of versions of some ids takes back and adds to the counts."""
    last = json.loads(state.get[0]) if state.exists else {}
    before = {}
    for f in frames:
        for id_, *row in zip(*(f[c].tolist() for c in ("event_id", "version", "at", "dt", "event_type", "k")), strict=True):
            id_, row[4] = str(id_), None if row[4] is None else int(row[4])
            known = last.get(id_)
            if known is None or _order(row) > _order(known):
                before.setdefault(id_, known)
                last[id_] = row
    if not before:
        return
    state.update((json.dumps(last),))
    counts: dict[tuple, list] = {}
    for id_, old in before.items():
        for row, sign in ((last[id_], 1), (old, -1)):
            if row is not None:
                count = counts.setdefault((row[2], row[3], row[4] is not None), [0, 0])
                count[0] += sign
                count[1] += sign * (row[4] or 0)
    rows = [(dt, kind, n, str(k) if there else None) for (dt, kind, there), (n, k) in counts.items() if n or k]
    yield pd.DataFrame(rows, columns=["dt", "event_type", "n", "k"])


def daily_changes(events: DataFrame) -> DataFrame:
    """(dt, event_type, n, k): changes of the daily counts, to be added up, as versions of events (event_id, ts, event_type, props, version) arrive.

    The state of an id is its last version; SPAN ids in a row are one row of state. A later version of it is counted where it belongs and the one before is taken
    back, whenever it comes: no watermark drops an event. An event without an id or a time isn't counted. State grows
    with the ids, so a store that keeps it on disk is used (see `drained`).
    """
    version = F.coalesce(F.col("version"), F.lit(0)).alias("version")
    k = F.get_json_object("props", "$.k").cast("long").cast("string").alias("k")  # a string, as pandas would make floats of longs with nulls
    e = events.where("event_id is not null and ts is not null")
    rows = e.select("event_id", version, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.to_date("ts").cast("string").alias("dt"), "event_type", k)
    spans = rows.withColumn("span", F.floor(F.col("event_id") / SPAN)).groupBy("span")
    changes = spans.applyInPandasWithState(_changed, "dt string, event_type string, n long, k string", _KEPT, "update", GroupStateTimeout.NoTimeout)
    return changes.withColumn("k", F.col("k").cast("long"))


def rolled_up(changes: DataFrame) -> DataFrame:
    """(dt, event_type, n, k): the counts that changes add up to; k is the sum of those there are."""
    s = changes.groupBy("dt", "event_type").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("_with_k"))
    return s.where("n <> 0").select("dt", "event_type", "n", F.when(F.col("_with_k") > 0, F.col("k")).alias("k"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(changes: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Run a stream of changes over what is there now and return all changes so far, added up for each batch.

    Changes, checkpoint and state are in the folder that the cluster shares (`where`, or a new one), so that a lost executor or driver
    goes on from there, and a later call with the same folder reads new files only. A batch that is repeated writes its own
    folder anew, so nothing counts twice.
    """
    from ..sources import shared

    spark = changes.sparkSession
    where = where or shared.place(spark, name)

    def sink(batch: DataFrame, epoch: int) -> None:
        summed = batch.groupBy("dt", "event_type", F.col("k").isNotNull().alias("_k")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        summed.select("dt", "event_type", "n", "k").write.mode("overwrite").parquet(f"{where}/out/epoch={epoch}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        q = changes.writeStream.outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        spark.conf.set(provider, before)
    q.awaitTermination()
    return spark.read.schema(_CHANGES + ", epoch long").parquet(f"{where}/out").drop("epoch")


def valid_interactions(interactions: DataFrame, searches: DataFrame) -> DataFrame:
    """Interactions (search_event_id, image_id) with `problem`: unknown_event, not_served or null; `searches`: (id, served)."""
    s = searches.select(F.col("id").alias("_id"), "served")
    j = interactions.join(s, interactions.search_event_id == s._id, "left")
    problem = F.when(F.col("_id").isNull(), "unknown_event").when(~F.array_contains("served", F.col("image_id")), "not_served")
    return j.select(*interactions.columns, problem.alias("problem"))


def retained(events: DataFrame, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Events of the last days before the newest one."""
    newest = events.agg(F.max("created_at").alias("_newest"))
    return events.join(F.broadcast(newest)).where(F.col("created_at") >= F.col("_newest") - F.make_interval(days=F.lit(days))).drop("_newest")
