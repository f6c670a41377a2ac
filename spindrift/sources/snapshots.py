"""Snapshots of tables that share what they have in common, and caches by fingerprint.

A table's rows are dealt by hash into chunks, and a chunk is named by what it holds: its rows' number and two sums of their hashes, whatever their
order. A snapshot writes the chunks that no whole snapshot has yet, then its manifest, by a rename: a snapshot without one doesn't exist.
A changed row is a chunk or two to write. The number of chunks depends on the rows by powers of two, so it seldom changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .segments import names, swapped, told

LATEST = "checkpoint-latest"
#: Chunks at least, and rows of a chunk at most, but for chance.
CHUNKS, ROWS = 64, 1_000_000


class Damaged(ValueError):
    """A snapshot that isn't what was written."""


def _content(df: DataFrame) -> list[Column]:
    """The name of a group of rows and their number."""
    sums = (F.sum(h.cast("decimal(20,0)")).cast("string") for h in (F.xxhash64(*df.columns), F.xxhash64(F.lit("second"), *df.columns)))
    return [F.left(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *sums), 256), F.lit(32)).alias("content"), F.count("*").alias("n")]


def _manifests(spark: SparkSession, folder: str) -> dict[str, dict]:
    out = {}
    for file in names(spark, f"{folder}/manifests"):
        try:
            out[file.removesuffix(".json")] = told(spark, f"{folder}/manifests", file)
        except ValueError:  # not JSON: the snapshot has no manifest
            continue
    return out


def snapshot(tables: dict[str, DataFrame], folder: str, label: str, at: str) -> dict[str, int]:
    """Take a snapshot, or take one of that label anew; how many chunks it has and how many had to be written."""
    spark = next(iter(tables.values())).sparkSession
    there = {(t, c["content"]): c["at"] for m in _manifests(spark, folder).values() for t, x in m["tables"].items() for c in x["chunks"]}
    place, manifest, written = uuid.uuid4().hex, {"label": label, "at": at, "tables": {}}, 0
    for name, df in tables.items():
        n, chunks = df.count(), CHUNKS
        while n > chunks * ROWS:
            chunks *= 2
        rows = df.withColumn("_chunk", F.pmod(F.xxhash64(*df.columns), F.lit(chunks)))
        found = rows.groupBy("_chunk").agg(*_content(df)).collect()  # a row for each chunk
        new = [r for r in found if (name, r.content) not in there]
        if new:
            named = spark.createDataFrame([(r["_chunk"], r.content) for r in new], "_chunk long, _content string")
            rows.join(F.broadcast(named), "_chunk").drop("_chunk").repartition("_content").write.partitionBy("_content").parquet(f"{folder}/objects/{name}/{place}")
            written += len(new)
        manifest["tables"][name] = {"schema": df.schema.json(), "n": n, "chunks": [{"content": r.content, "n": r.n, "at": there.get((name, r.content), place)} for r in found]}
    swapped(spark, f"{folder}/manifests", manifest, f"{label}.json")
    return {"chunks": sum(len(x["chunks"]) for x in manifest["tables"].values()), "written": written}


def choice(spark: SparkSession, folder: str, local: int) -> DataFrame:
    """(label, n, at) of the snapshots to restore from, best first: the rolling one, then the newest, if they have more rows than there are here."""
    rows = [(label, sum(x["n"] for x in m["tables"].values()), m["at"]) for label, m in _manifests(spark, folder).items()]
    found = spark.createDataFrame(rows, "label string, n long, at string")
    return found.where((F.col("n") > local) & (F.col("n") > 0)).orderBy((F.col("label") == LATEST).desc(), F.col("at").desc(), F.col("label").desc())


def restore(spark: SparkSession, folder: str, label: str) -> dict[str, DataFrame]:
    """A snapshot's tables; Damaged if a chunk is missing or isn't what its name says."""
    m = _manifests(spark, folder).get(label)
    if m is None:
        raise Damaged(f"snapshot {label} isn't there or isn't whole")
    out = {}
    for name, x in m["tables"].items():
        schema, table = StructType.fromJson(json.loads(x["schema"])), None
        for place in sorted({c["at"] for c in x["chunks"]}):
            here = [c["content"] for c in x["chunks"] if c["at"] == place]
            try:
                some = spark.read.schema(StructType([*schema.fields]).add("_content", "string")).parquet(f"{folder}/objects/{name}/{place}").where(F.col("_content").isin(here))
                rows = some.drop("_content")
                good = {r["_content"] for r in some.groupBy("_content").agg(*_content(rows)).where("_content = content").collect()}
            except Exception as e:  # whatever a reader says of files that are gone or damaged
                raise Damaged(f"snapshot {label}: {name} can't be read: {str(e).splitlines()[0][:200]}") from e
            if good != set(here):
                raise Damaged(f"snapshot {label}: {len(set(here) - good)} chunks of {name} have changed")
            table = rows if table is None else table.union(rows)
        out[name] = spark.createDataFrame([], schema) if table is None else table
    return out


def restore_best(spark: SparkSession, folder: str, local: int = 0) -> tuple[str | None, dict[str, DataFrame], list[str]]:
    """The label and tables of the first whole snapshot of `choice`, and what was wrong with those before it."""
    wrong = []
    for r in choice(spark, folder, local).collect():  # a row for each snapshot
        try:
            return r.label, restore(spark, folder, r.label), wrong
        except Damaged as e:
            wrong.append(str(e))
    return None, {}, wrong


def cached(requests: DataFrame, cache: DataFrame, key: str, default: Column) -> DataFrame:
    """Requests with `result` of the cache by key, or the default."""
    c = cache.groupBy(key).agg(F.max_by("result", "at").alias("result"))
    return requests.join(c, key, "left").withColumn("result", F.coalesce("result", default))
