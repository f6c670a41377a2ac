"""The event log: gzip JSON by day, the last document of an id counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SEARCH = "id long, created_at timestamp, search_kind string, user_id long, result_count long, top_score double, version int, _corrupt_record string, dt date"


def write(events: DataFrame, folder: str) -> None:
    """Append events to their days; a later version of an id takes the place of the earlier one when read."""
    events.withColumn("dt", F.to_date("created_at")).write.mode("append").partitionBy("dt").option("compression", "gzip").json(folder)


#: Days that become a filter of the scan; more of them are joined.
LISTED = 10_000


def _rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    e = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return e.where("id is not null")


def _last(e: DataFrame) -> DataFrame:
    """Of each id the last version; a rewrite has the day of the event, so versions of an id share a partition."""
    order = Window.partitionBy("dt", "id").orderBy(F.coalesce("version", F.lit(0)).desc(), F.col("created_at").desc())
    return e.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_corrupt_record")


def read(spark: SparkSession, folder: str, since: str | None = None, until: str | None = None, schema: str = SEARCH) -> DataFrame:
    """Events between two times: days are pruned by partition, then times compared; documents that can't be read are left out."""
    e = _rows(spark, folder, schema)
    if since:
        e = e.where((F.col("dt") >= F.to_date(F.lit(since))) & (F.col("created_at") >= F.lit(since).cast("timestamp")))
    if until:
        e = e.where((F.col("dt") <= F.to_date(F.lit(until))) & (F.col("created_at") <= F.lit(until).cast("timestamp")))
    return _last(e)


def lookup(spark: SparkSession, folder: str, pointers: DataFrame, ids: DataFrame, schema: str = SEARCH) -> DataFrame:
    """Events by id: a table of pointers (id, dt) tells which days to read.

    The days are a partition filter of the scan, so the days' folders alone are listed and read. Ids are compared before versions are,
    so only the wanted events are shuffled. Beyond LISTED days, the days of the pointers are joined first.
    """
    wanted = shared.materialised(pointers.join(ids.select("id").distinct(), "id").select("id", "dt").distinct(), "pointers")
    days = [r.dt for r in wanted.select("dt").distinct().limit(LISTED + 1).collect()]
    e = _rows(spark, folder, schema)
    if len(days) <= LISTED:
        e = e.where(F.col("dt").isin(days))
    else:
        e = e.join(wanted.select("dt").distinct(), "dt", "left_semi")
    return _last(e.join(wanted, ["dt", "id"], "left_semi"))
