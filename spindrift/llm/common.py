"""What the operators of this subpackage share: shared storage, hashing and small helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that its lineage is cut and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spindrift-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(forget)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete every table that materialise() has written; at exit at the latest."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended: the cluster's own cleaning of the folder is all that is left
            pass


def tidy(read: Callable) -> Callable:
    """A function of batches that gives freed memory back to the system when its task ends, as workers are used again."""

    def run(batches):
        try:
            yield from read(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all further columns as one struct, so that no name of theirs meets one of an operator's own."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(_quoted(c) for c in rest)).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))


def restored(ours: DataFrame, docs: DataFrame, *more: str | Column) -> DataFrame:
    """The columns of `docs` again, out of a table with those of carried(), and `more` of that table's own."""
    return ours.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns), *more)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def texts(column) -> Iterator[str]:
    """Python strings of an Arrow column, a few at a time; null is the empty text."""
    for i in range(0, len(column), 256):
        for x in column.slice(i, 256).to_pylist():
            yield x or ""


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes, so that any of their bits can be used (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of `width` values: prefix and suffix minima of blocks."""
    m = len(h)
    blocks = -(-m // width)
    padded = np.full(blocks * width, np.iinfo(h.dtype).max, h.dtype)
    padded[:m] = h
    padded = padded.reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(after[: m - width + 1], before[width - 1 : m])


#: Low bits of a hash that give way to its place; no text has more bytes than this can count.
PLACE_BITS = np.uint64(31)
PLACE = np.uint64((1 << 31) - 1)


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes, where its leftmost minimum stands (hashes are compared by their top 33 bits)."""
    placed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(placed, width) & PLACE).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of equal neighbours."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return np.r_[0, cuts], np.r_[cuts, len(values)]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs; those that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.r_[True, start[1:] > reach[:-1]]
    return start[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(start) - 1]]


def labelled(docs: DataFrame, labels: DataFrame, learn: str, sample: int) -> tuple[list[tuple[str, int]], float]:
    """At most `sample` texts of each label, and the share of label 1 among all labels.

    `labels` has (doc_id, label); `learn` is the condition on doc_id of the rows that may be learnt from. The sample
    has the smallest hashes of doc_id; of rows that share a doc_id it has the smallest text.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").where(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    many = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 0").orderBy(order, "doc_id").limit(sample).union(known.where("label = 1").orderBy(order, "doc_id").limit(sample))
    # at most 2 * sample ids, so they may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("text")).orderBy("doc_id").collect()
    return [(r.text, int(r.label)) for r in rows], many.get(1, 0) / max(1, sum(many.values()))


def os_nice_threads() -> None:
    """Executors run one task a core; libraries must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
