"""Queries of streams, sessions and other state (X, W08, W09)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import shared
from ..streaming import admission as A
from ..streaming import events as E
from ..streaming import lru as L
from ..streaming import queue as Q
from ..streaming import sessions as S
from .registry import query
from .views import interactions, searches, sql, table


_DAILY = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k
FROM events GROUP BY 1, 2"""


@query("x01_streaming_daily", _DAILY)
def streaming_daily(spark, d):
    """The daily roll-up by a stream that is run until nothing is left; equal to the batch result."""
    changes = E.daily_changes(E.stream(spark, f"{d}/event[s].parquet"))
    return E.rolled_up(E.drained(changes, "daily"))


@query("x01_late_and_rewritten", _DAILY)
def late_and_rewritten(spark, d):
    """The same from a log in which events come late, again and corrected, a batch of files at a time.

    The first run of the stream sees the first version of a fifth of the events, with another type and two weeks off, and the
    events of the second half of the month. The second run sees the corrections, the first half, and what came before again.
    """
    where = shared.place(spark, "log")
    e = table(spark, d, "events").withColumn("version", F.lit(2).cast("long"))
    wrong = e.where("event_id % 5 = 0").withColumn("version", F.lit(1).cast("long")).withColumn("event_type", F.concat(F.lit("not "), "event_type")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 14 DAYS"))
    late = F.dayofmonth("ts") <= 15
    runs = shared.place(spark, "daily")
    for rows in (wrong.union(e.where("event_id % 5 <> 0").where(~late)), e.where("event_id % 5 = 0").union(e.where(late)).union(wrong)):
        rows.repartition(4).write.mode("append").parquet(where)
        found = E.drained(E.daily_changes(E.stream(spark, where, 2)), "daily", runs)
    return E.rolled_up(found)


@query("x02_interaction_validation", sql("searches interactions", "SELECT i.id, CASE WHEN s.id IS NULL THEN 'unknown_event' WHEN i.image_id NOT IN (s.k, s.k + 1, s.k + 2) THEN 'not_served' END AS problem FROM interactions i LEFT JOIN searches s ON s.id = i.search_event_id"))
def interaction_validation(spark, d):
    k = F.col("k")
    served = searches(spark, d).select("id", F.array(k, k + 1, k + 2).alias("served"))
    return E.valid_interactions(interactions(spark, d), served).select("id", "problem")


@query("x03_retention", sql("searches", "SELECT id FROM searches WHERE created_at >= (SELECT max(created_at) FROM searches) - INTERVAL 7 DAYS"))
def retention(spark, d):
    return E.retained(searches(spark, d), 7).select("id")


@query("x05_session_state", """WITH e AS (SELECT event_id AS id, user_id, ts, CASE event_type WHEN 'signup' THEN 'reset' WHEN 'purchase' THEN 'similar' ELSE 'ask' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT *, count(*) FILTER (kind = 'reset') OVER w AS era FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT id, era, count(*) FILTER (kind = 'ask') OVER v AS turns, CASE WHEN kind = 'reset' THEN NULL ELSE id END AS last_spec, CASE WHEN kind = 'reset' THEN [] ELSE list_transform(generate_series(1, least(k % 10, 5)), lambda x: k + x) END AS last_results,
  kind = 'ask' AND count(*) FILTER (kind <> 'reset') OVER v > 1 AS refines FROM r WINDOW v AS (PARTITION BY user_id, era ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
def session_state(spark, d):
    """A session after each of its events: a question is a turn that may refine, a similar search is a new anchor, a reset clears all."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "purchase", "similar").otherwise("ask")
    many = F.least(F.col("k") % 10, F.lit(5))
    results = F.when(many > 0, F.transform(F.sequence(F.lit(1).cast("long"), many), lambda x: F.col("k") + x)).otherwise(F.array().cast("array<bigint>"))
    return S.states(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("ts").alias("at"), kind.alias("kind"), results.alias("results")))


@query("x04_ttl_cache", """WITH e AS (SELECT user_id AS key, ts AS t, event_id AS id, event_type = 'click' AS stores FROM events),
p AS (SELECT key, t, id, stores, max(CASE WHEN stores THEN epoch_us(t) END) OVER w AS stored_us, count(*) FILTER (stores) OVER w AS version FROM e WINDOW w AS (PARTITION BY key ORDER BY t, id ROWS UNBOUNDED PRECEDING))
SELECT id, stored_us IS NOT NULL AND epoch_us(t) - stored_us <= 21600000000 AS hit, version FROM p WHERE NOT stores""")
def ttl_cache(spark, d):
    """Lookups of a cache whose entries live six hours."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "click").alias("stores"))
    return S.ttl_lookups(e, 6 * 3600)


@query("x07_queue_chunks", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS chunk FROM events")
def queue_chunks(spark, d):
    """Jobs in chunks, each claimed in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.floor((F.row_number().over(w) - 1) / 8).alias("chunk"))


@query("x07_queue_worked", "SELECT event_id, 1 AS times, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def queue_worked(spark, d):
    """Every job done once by a queue whose first worker fails at its third chunk and whose second one goes on."""
    inbox, where = shared.place(spark, "inbox"), shared.place(spark, "queue")
    table(spark, d, "events").select("event_id", "props").repartition(6, "event_id").write.parquet(inbox)
    begun = []

    def step(batch):
        begun.append(1)
        if len(begun) == 3:
            raise RuntimeError("the worker is gone")
        return batch.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))

    try:
        Q.worked(spark, inbox, "event_id long, props string", where, step)
    except StreamingQueryException:
        pass
    done = Q.worked(spark, inbox, "event_id long, props string", where, step)
    return done.groupBy("event_id").agg(F.count("*").cast("int").alias("times"), F.max("k").alias("k"))


@query("w08_admission")
def admission(spark, d):
    """A rate limit per user of one event in six hours."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return A.admitted(e, "user_id", "event_id", "at", 1, 6 * 3600)


@query("w09_sessions", "WITH m AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 7200 SECONDS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts) AS session FROM m) SELECT key, session, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS first FROM s GROUP BY 1, 2")
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return A.sessions(e, "user_id", "at").select("key", "session", "n", F.unix_micros("first").alias("first"))


@query("w09_session_store")
def session_store(spark, d):
    """Which events create a session in a store of 1,000 whose sessions go after two hours: ten sessions for each user."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    key = F.col("user_id") * 10 + F.get_json_object("props", "$.k").cast("long") % 10
    return L.created(e.withColumn("session", key), "session", "at", "event_id")
