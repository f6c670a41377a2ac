"""Blobs by key under a root of any file system that executors can reach: written, read, deleted and looked up in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(r"[^/\x00]+(?:/[^/\x00]+)*")


def _checked(key: str) -> str:
    """A key stays below its root."""
    if not _KEY.fullmatch(key or "") or any(p in (".", "..") for p in key.split("/")):
        raise ValueError(f"not a key: {key!r}")
    return key


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def put(blobs: DataFrame, root: str) -> DataFrame:
    """(key, size) of blobs (key, content), each written beside and moved into place, so that a task that runs twice leaves one whole blob."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = _system(root)
        for b in batches:
            keys, sizes = [], []
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                path = f"{base}/{_checked(key)}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                data = content.as_py() or b""
                aside = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(aside) as out:
                    out.write(data)
                system.move(aside, path)
                keys.append(key)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], names=["key", "size"])

    return blobs.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(write, "key string, size long")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(key, size, modified_at) of all blobs below the root that aren't empty; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(~F.col("path").endswith(".part"))
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    key = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    return found.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def get(keys: DataFrame, root: str) -> DataFrame:
    """(key, content) of keys (key); null where there is no such blob."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for b in batches:
            for key in b.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{_checked(key)}") as f:
                        content = f.read()
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([content], pa.binary())], names=["key", "content"])

    return keys.select("key").mapInArrow(read, "key string, content binary")


def delete(keys: DataFrame, root: str) -> DataFrame:
    """(key, deleted): false where there was none, so that deleting twice does no harm."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for b in batches:
            done = []
            for key in b.column(0).to_pylist():
                try:
                    system.delete_file(f"{base}/{_checked(key)}")
                    done.append(True)
                except FileNotFoundError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.bool_())], names=["key", "deleted"])

    return keys.select("key").mapInArrow(remove, "key string, deleted boolean")
