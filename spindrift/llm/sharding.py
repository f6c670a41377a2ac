"""Shards of near equal size in which equal texts stay together: longest-processing-time scheduling.

Equal texts are a group, told apart by SHA-256. Groups of at least 1/GRAIN of a shard's fair share are items of their own; smaller
ones are bundled by hash into shards * GRAIN bundles, so there are at most 2 * shards * GRAIN items whatever the table's size. The items,
sorted by size, go one after another to the least loaded shard by a heap on the driver; that sees sizes only. A bundle holds about as
much as the smallest large group, so shards differ by about 1/GRAIN of their size, unless one group is larger than a share.

Documents learn their shard from two tables that are broadcast: the large groups and the bundles, each at most shards * GRAIN
rows. No document is shuffled for that. `slots` numbers the rows of each shard from 0: within the pieces that a table was
written in, then by the sums of the pieces before.

Cases: a null text has no bytes and goes with empty texts; null doc_ids and repeated rows are documents like any others, one slot
each; ties in size go by group, then to the shard of the smallest number; an empty table gives an empty result; columns named like
those added here are kept where the operator returns them under `rest` only.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 24
#: Parts of a shard's fair share.
GRAIN = 1_000
#: Bytes that a document takes besides its text.
EXTRA = 8


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """The shard of every item (size, name): largest first, each to the least loaded; ties by name, then by shard."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        placed[name] = shard
    return placed


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_size", F.octet_length(text).cast("long") + EXTRA).withColumn("_group", F.unhex(F.sha2(text, 256)))


def placed(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """The table with `size` and `shard`; docs has doc_id and text, and further columns by names that are not those two."""
    spark, bundles = docs.sparkSession, shards * grain
    groups = _keyed(docs.select("text")).groupBy("_group").agg(F.sum("_size").alias("size"))
    groups = materialise(groups, "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("size") * bundles >= total)  # at most `bundles` of them
    small = groups.where(F.col("size") * bundles < total)
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int").alias("_bundle")
    big = [(r["size"], bytes(r["_group"])) for r in large.collect()]
    sizes = [(r["size"], r["_bundle"].to_bytes(4, "big")) for r in small.groupBy(bundle).agg(F.sum("size").alias("size")).collect()]
    # names of groups have 32 bytes and those of bundles 4, so they don't meet
    found = lpt(big + sizes, shards)
    own = spark.createDataFrame([(bytearray(g), s) for g, s in found.items() if len(g) > 4], "_group binary, _own int")
    shared = spark.createDataFrame([(int.from_bytes(g, "big"), s) for g, s in found.items() if len(g) == 4], "_bundle int, _shared int")
    rows = _keyed(docs).withColumn("_bundle", bundle)
    rows = rows.join(F.broadcast(own), "_group", "left").join(F.broadcast(shared), "_bundle", "left")
    return rows.withColumn("size", F.col("_size")).withColumn("shard", F.coalesce("_own", "_shared")).drop("_size", "_group", "_bundle", "_own", "_shared")


def slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """The table, written once, with `slot`: its rows numbered from 0 in each shard."""
    pieces = materialise(rows.withColumn("_piece", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    many = pieces.groupBy(shard, "_piece").agg(F.count("*").alias("_many"))
    many = many.select(shard, "_piece", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(shard, "_piece").orderBy("_row")) - 1
    return pieces.withColumn("_own", own).join(many, [shard, "_piece"]).withColumn("slot", (F.col("_before") + F.col("_own")).cast("long")).drop("_piece", "_row", "_own", "_before")


def sharded(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """(doc_id, text, rest, size, shard, slot): whole documents, further columns as the struct `rest`."""
    from .common import carried

    return slots(placed(carried(docs), shards, grain))


def written(docs: DataFrame, folder: str, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """The shards as Parquet files, a folder shard=<number> for each, rows in order of slot within a file."""
    made = sharded(docs, shards, grain)
    made.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
