"""A queue of jobs that one worker at a time takes, works through in chunks of files, and gives up when its worker dies.

Jobs are files in a folder; their order and which of them are done are a stream's checkpoint. A worker claims the queue by a small file
that it renews every few seconds while it runs; a claim that isn't renewed for `lease` seconds is dead, and the next worker goes on: chunks that were
committed stay, and the one that was under way is done again, into its own folder, so no row counts twice.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.segments import swapped, told

CLAIM = "claim.json"
HEARTBEAT = 5.0


class Busy(RuntimeError):
    """Another worker has the queue and is alive."""


def claimed(spark: SparkSession, where: str, worker: str, lease: float) -> str | None:
    """Claim the queue; the worker whose dead claim it was, or none. Of two that claim at once the one whose claim stays has it."""
    found = told(spark, where, CLAIM)
    if found and not found["ended"] and found["worker"] != worker and time.time() - found["at"] < lease:
        raise Busy(f"{found['worker']} has it")
    swapped(spark, where, {"worker": worker, "at": time.time(), "ended": False}, CLAIM)
    if told(spark, where, CLAIM)["worker"] != worker:
        raise Busy("another worker was faster")
    return found["worker"] if found and not found["ended"] and found["worker"] != worker else None


def worked(spark: SparkSession, inbox: str, schema: str, where: str, step: Callable[[DataFrame], DataFrame], files: int = 1, heartbeat: float = HEARTBEAT, lease: float | None = None) -> DataFrame:
    """All results so far, with their `chunk`, once `step` has been applied to the jobs that are there: Parquet files of `inbox`, `files` of them a chunk.

    An error in a step ends the run and the claim; the next run begins with that chunk.
    """
    worker, stop = uuid.uuid4().hex, threading.Event()
    claimed(spark, where, worker, 3 * heartbeat if lease is None else lease)

    def alive() -> None:
        while not stop.wait(heartbeat):
            swapped(spark, where, {"worker": worker, "at": time.time(), "ended": False}, CLAIM)

    def chunk(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{where}/results/chunk={number}")

    beat = threading.Thread(target=alive, daemon=True)
    beat.start()
    try:
        jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(inbox)
        jobs.writeStream.option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).foreachBatch(chunk).start().awaitTermination()
    finally:
        stop.set()
        beat.join()
        swapped(spark, where, {"worker": worker, "at": time.time(), "ended": True}, CLAIM)
    return spark.read.parquet(f"{where}/results")
