"""A queue whose workers fail and die."""

import time

import pytest
from pyspark.sql import functions as F

from spindrift.sources import segments
from spindrift.streaming import queue


def jobs(spark, folder, first, many):
    for k in range(many):
        spark.range(first + 10 * k, first + 10 * k + 10).coalesce(1).write.mode("append").parquet(folder)


def test_a_failed_run_goes_on_with_its_chunk(spark, tmp_path):
    inbox, where, calls = str(tmp_path / "in"), str(tmp_path / "queue"), []
    jobs(spark, inbox, 0, 4)

    def step(batch, fails=()):
        calls.append(batch.count())
        if len(calls) in fails:
            raise ValueError("a bad job")
        return batch.select("id", (F.col("id") * 2).alias("twice"))

    with pytest.raises(Exception, match="a bad job"):
        queue.worked(spark, inbox, "id long", where, lambda b: step(b, (3,)))
    assert segments.told(spark, where, queue.CLAIM)["ended"]
    found = queue.worked(spark, inbox, "id long", where, step)
    assert sorted((r.id, r.twice) for r in found.collect()) == [(i, 2 * i) for i in range(40)] and len(calls) == 5
    jobs(spark, inbox, 100, 1)
    found = queue.worked(spark, inbox, "id long", where, step)
    assert found.count() == 50 and len(calls) == 6 and found.select("chunk").distinct().count() == 5


def test_a_live_claim_holds_and_a_dead_one_does_not(spark, tmp_path):
    inbox, where = str(tmp_path / "in"), str(tmp_path / "queue")
    jobs(spark, inbox, 0, 1)
    segments.swapped(spark, where, {"worker": "other", "at": time.time(), "ended": False}, queue.CLAIM)
    with pytest.raises(queue.Busy):
        queue.worked(spark, inbox, "id long", where, lambda b: b)
    segments.swapped(spark, where, {"worker": "other", "at": time.time() - 60, "ended": False}, queue.CLAIM)
    assert queue.claimed(spark, where, "me", 15.0) == "other"
    segments.swapped(spark, where, {"worker": "other", "at": time.time() - 60, "ended": False}, queue.CLAIM)
    assert queue.worked(spark, inbox, "id long", where, lambda b: b).count() == 10


def test_the_claim_is_renewed(spark, tmp_path):
    inbox, where, seen = str(tmp_path / "in"), str(tmp_path / "queue"), []
    jobs(spark, inbox, 0, 1)

    def step(batch):
        for _ in range(3):
            seen.append(segments.told(spark, where, queue.CLAIM)["at"])
            time.sleep(0.5)
        return batch

    queue.worked(spark, inbox, "id long", where, step, heartbeat=0.2)
    assert len(set(seen)) == 3
