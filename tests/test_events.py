"""The event log and its roll-ups: versions that come late or again, and lookups that read their days only."""

import datetime as dt
import itertools
import re

import pytest
from pyspark.sql import functions as F

from spindrift.sources import events as log
from spindrift.streaming import events as E

AT = dt.datetime(2024, 3, 15, 12)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string, version long"


def event(i, days, kind, k, version):
    return (i, AT + dt.timedelta(days=days), 1, kind, 1.0, None if k is None else f'{{"k": {k}}}', version)


#: Three files: the third has an event of ten days before, rewrites of another day, type and k, and older versions.
FILES = [
    [event(1, 0, "view", 1, 1), event(2, 0, "view", 2, 1), event(3, 1, "click", None, None), event(70, 1, "click", 5, 1)],
    [event(2, 0, "click", 7, 2), event(4, 2, "view", 4, 1), event(5, 2, None, 3, 1), event(1, 0, "view", 1, 1)],
    [event(6, -10, "view", 9, 1), event(70, -3, "view", None, 3), event(2, 5, "wrong", 0, 1), event(4, 2, "view", 40, 2), event(None, 0, "view", 1, 1), (9, None, 1, "view", 1.0, None, 1)],
]


def batch(files):
    last = {}
    for i, at, _, kind, _, props, version in itertools.chain(*files):
        if i is not None and at is not None and (version or 0) >= last.get(i, (-1,))[0]:
            last[i] = (version or 0, at.date().isoformat(), kind, None if props is None else int(re.sub(r"\D", "", props)))
    out = {}
    for _, day, kind, k in last.values():
        n, s = out.get((day, kind), (0, None))
        out[day, kind] = (n + 1, s if k is None else (s or 0) + k)
    return out


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_files_in_any_order_give_the_batch_roll_up(spark, tmp_path, order):
    folder, where = str(tmp_path / "in"), str(tmp_path / "run")
    for n, f in enumerate(order):  # a run of the stream for each file, going on from the last
        spark.createDataFrame(FILES[f], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        found = E.rolled_up(E.drained(E.daily_changes(E.stream(spark, folder, 1)), "daily", where))
        if n in (0, 2):
            assert {(r.dt, r.event_type): (r.n, r.k) for r in found.collect()} == batch(FILES[x] for x in order[: n + 1])


def test_nothing_twice(spark, tmp_path):
    """The same rows in one batch and in the next, and a run without new files."""
    folder, where = str(tmp_path / "in"), str(tmp_path / "run")
    for _ in range(2):
        spark.createDataFrame(FILES[0] + FILES[0], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        E.drained(E.daily_changes(E.stream(spark, folder)), "daily", where)
    found = E.rolled_up(E.drained(E.daily_changes(E.stream(spark, folder)), "daily", where))
    assert {(r.dt, r.event_type): (r.n, r.k) for r in found.collect()} == batch([FILES[0]])


def searches(spark):
    return spark.range(300).select("id", (F.timestamp_seconds(F.lit(1704067200)) + F.make_dt_interval(hours=(F.col("id") * 3).cast("int"))).alias("created_at"), F.lit("ask").alias("search_kind"), F.lit(1).cast("long").alias("user_id"), F.col("id").alias("result_count"), F.lit(0.5).alias("top_score"), F.lit(0).alias("version"))


def test_lookup_reads_its_days_only(spark, tmp_path):
    where, s = str(tmp_path / "log"), searches(spark)
    log.write(s, where)
    log.write(s.where("id % 4 = 0").withColumn("result_count", F.lit(-1).cast("long")).withColumn("version", F.lit(1)), where)
    pointers = s.select("id", F.to_date("created_at").alias("dt"))
    found = log.lookup(spark, where, pointers, spark.createDataFrame([(8,), (9,), (100,), (100,), (5000,)], "id long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ IN", plan) and set(re.findall(r"2024-\d\d-\d\d", plan)) == {"2024-01-02", "2024-01-13"}
    rows = {r.id: r.result_count for r in found.collect()}
    assert rows == {8: -1, 9: 9, 100: -1}


def test_lookup_beyond_the_listed_days(spark, tmp_path, monkeypatch):
    where, s = str(tmp_path / "log"), searches(spark)
    log.write(s, where)
    monkeypatch.setattr(log, "LISTED", 3)
    found = log.lookup(spark, where, s.select("id", F.to_date("created_at").alias("dt")), s.where("id % 2 = 0").select("id"))
    assert found.count() == 150
