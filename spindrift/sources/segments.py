"""Tables kept as immutable segments, and the one small file that says which of them count.

A segment is a folder of tables that is written once. Each names, in `touched`, the ids whose rows in earlier segments are dead: those
that it holds anew and those deleted. The pointer, a file of JSON, lists the segments in order with the rows and the checksum of each table,
and whatever facts its user keeps; it is replaced by a rename, so a reader sees the store before a change or after it (see `told`). A reader
opens the pointer and nothing else: no folder is listed for a query but by the scans of the segments' own tables.

Segments that no pointer names any more are deleted by `swept`, when no reader is left that may have opened an older one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"
#: Ids that become a filter of scans; more are joined.
LISTED = 1_000
#: Segments that a change leaves; beyond that they are merged.
MOST = 8


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _json(spark: SparkSession, fs, path) -> dict:
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def told(spark: SparkSession, folder: str, name: str = POINTER) -> dict | None:
    """What the pointer says; none if there is no store yet, an error if the pointer can't be read.

    Where a rename over a file first deletes that, as on local disks, the pointer may be away for a moment, or for good if its writer
    stopped then: the new one lies whole beside it.
    """
    path, fs = _path(spark, f"{folder}/{name}")
    for _ in range(3):
        if fs.exists(path):
            try:
                return _json(spark, fs, path)
            except Py4JJavaError:  # replaced just now
                if fs.exists(path):
                    continue
        beside = fs.globStatus(_path(spark, f"{folder}/_{name}.*")[0]) or []
        for s in sorted(beside, key=lambda s: -s.getModificationTime()):
            try:
                return _json(spark, fs, s.getPath())
            except (ValueError, Py4JJavaError):  # half written, or renamed meanwhile
                continue
        if not fs.exists(path):
            return None
    return _json(spark, fs, path)


def swapped(spark: SparkSession, folder: str, content: dict, name: str = POINTER) -> None:
    """Write a small file of JSON beside the old one and rename it over that."""
    new, fs = _path(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(json.dumps(content).encode())
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, _path(spark, f"{folder}/{name}")[0], over)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder that holds small files only, those that are being written left out."""
    path, fs = _path(spark, folder)
    return sorted(n for n in (s.getPath().getName() for s in (fs.listStatus(path) if fs.exists(path) else [])) if not n.startswith(("_", ".")))


def removed(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def _checked(df: DataFrame) -> tuple[int, str]:
    n, check = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    return n, str(check)


@dataclass
class Segments:
    """A store at one state: `parts` in order, and its `facts`. `schemas` gives each table's columns; all but `touched` have an id."""

    spark: SparkSession
    folder: str
    schemas: dict[str, str]
    parts: list[dict] = field(default_factory=list)
    facts: dict = field(default_factory=dict)

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, schemas: dict[str, str]) -> Segments:
        found = told(spark, folder) or {"parts": [], "facts": {}}
        return cls(spark, folder, schemas, found["parts"], found["facts"])

    def _read(self, part: dict, table: str) -> DataFrame:
        schema = self.schemas.get(table) or self._ids()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part['name']}/{table}")

    def _ids(self) -> str:
        kinds = {c.split()[1] for s in self.schemas.values() for c in s.split(", ") if c.startswith("id ")}
        return "id " + kinds.pop()

    def live(self, table: str, where=None) -> DataFrame:
        """Rows of a table that no later segment has taken back; `where` reaches the scans."""
        out = None
        for k, part in enumerate(self.parts):
            rows = self._read(part, table)
            rows = rows if where is None else rows.where(where)
            for later in self.parts[k + 1 :]:
                rows = rows.join(self._read(later, "touched"), "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)  # a join puts its key first
        return self.spark.createDataFrame([], self.schemas[table]) if out is None else out

    def of(self, table: str, ids: DataFrame) -> DataFrame:
        """Live rows of some ids: few ids are a filter on the scans, which skips row groups of tables that are sorted by id."""
        some = [r.id for r in ids.select("id").distinct().limit(LISTED + 1).collect()]
        if len(some) <= LISTED:
            return self.live(table, F.col("id").isin(some))
        return self.live(table).join(ids.select("id").distinct(), "id", "left_semi")

    def _write(self, tables: dict[str, DataFrame], touched: DataFrame) -> dict:
        part = {"name": f"segment-{uuid.uuid4().hex}", "tables": {}}
        for table, df in {**tables, "touched": touched}.items():
            df.write.parquet(f"{self.folder}/{part['name']}/{table}")
            part["tables"][table] = _checked(self._read(part, table))
        return part

    def changed(self, tables: dict[str, DataFrame], touched: DataFrame, facts=None) -> Segments:
        """The store with one more segment, once the pointer names it; `facts(store)` makes the new facts from that state."""
        part = self._write(tables, touched.select("id").distinct())
        new = Segments(self.spark, self.folder, self.schemas, [*self.parts, part], self.facts)
        new.facts = facts(new) if facts else self.facts
        swapped(self.spark, self.folder, {"parts": new.parts, "facts": new.facts})
        return new.merged() if len(new.parts) > MOST else new

    def merged(self, order: dict[str, list[str]] | None = None) -> Segments:
        """The same rows in one segment. Tables are sorted by their first column, or as `order` says."""
        sort = lambda t: (order or {}).get(t) or [self.schemas[t].split()[0]]
        tables = {t: self.live(t).repartitionByRange(*sort(t)).sortWithinPartitions(*sort(t)) for t in self.schemas}
        part = self._write(tables, self.spark.createDataFrame([], self._ids()))
        new = Segments(self.spark, self.folder, self.schemas, [part], self.facts)
        swapped(self.spark, self.folder, {"parts": new.parts, "facts": new.facts})
        return new

    def broken(self) -> list[tuple[str, str, str]]:
        """(segment, table, what is wrong) of all tables that aren't what was written."""
        out = []
        for part in self.parts:
            for table, (n, check) in part["tables"].items():
                try:
                    found = _checked(self._read(part, table))
                except Exception as e:  # whatever a reader says of files that are gone or damaged is what is wrong
                    out.append((part["name"], table, str(e).split("\n")[0][:200]))
                else:
                    if found != (n, check):
                        out.append((part["name"], table, f"{found[0]} rows instead of {n}" if found[0] != n else "other rows"))
        return out

    def swept(self) -> list[str]:
        """Delete the segments that this state doesn't name; their names."""
        path, fs = _path(self.spark, self.folder)
        named, gone = {p["name"] for p in self.parts}, []
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name.startswith("segment-") and name not in named:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)
