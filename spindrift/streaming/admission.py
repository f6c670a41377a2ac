"""Operators with state per key: rate limits and sessions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def admitted(events: DataFrame, key: str, id_: str, at: str, limit: int = V.RATE_LIMIT, seconds: int = V.RATE_SECONDS) -> DataFrame:
    """(key, id, admitted): an event is admitted if fewer than `limit` admitted ones lie in the `seconds` before it.

    Only admitted events count, so a window frame can't tell. Events are dealt by key and streamed in order of time; the
    state is the times of at most `limit` events, however many a key has.
    """

    def run(batches):
        current, times = None, deque()
        for b in batches:
            out = []
            for k, i, t in zip(b[key], b[id_], b["_t"]):
                if k != current:
                    current, times = k, deque()
                while times and t - times[0] > seconds:
                    times.popleft()
                ok = len(times) < limit
                if ok:
                    times.append(t)
                out.append((k, i, ok))
            yield pd.DataFrame(out, columns=["key", "id", "admitted"])

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = events.select(key, id_, F.unix_micros(F.col(at)).cast("double").alias("_t")).withColumn("_t", F.col("_t") / 1e6)
    return e.repartition(parts, key).sortWithinPartitions(key, "_t", id_).mapInPandas(run, "key long, id long, admitted boolean")


def sessions(events: DataFrame, key: str, at: str, ttl: int = V.SESSION_TTL) -> DataFrame:
    """(key, session, first, last, n): runs of a key's events without a pause of more than `ttl` seconds."""
    w = Window.partitionBy(key).orderBy(at)
    pause = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > ttl * 1_000_000
    marked = events.withColumn("_new", F.coalesce(pause, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(F.col(key).alias("key"), "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
