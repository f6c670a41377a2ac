"""Repair of an index in phases, each committed once in a ledger, so that a stopped run goes on where it was.

The stores are tables: `records`, `vectors`, `text_vectors` and `thumbs`. A phase tells which rows it has to mend, mends them and writes
the tables that change to a folder of its own; the ledger, a small file, then names that folder by a rename. A phase that stopped before that left
no trace but files that nothing names, and begins anew; one after it is done and isn't repeated. Phases without work write nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.segments import swapped, told

LEDGER = "ledger.json"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Phase:
    """`work` has the rows to mend (image_id); `mended` the tables after that, of which `changes` differ."""

    name: str
    work: Callable[[Tables], DataFrame]
    mended: Callable[[Tables, DataFrame], Tables]
    changes: tuple[str, ...]


def _put(table: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` in place of those of the same id."""
    return table.join(new.select("image_id"), "image_id", "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def _active(t: Tables) -> DataFrame:
    return t["records"].where("not deleted")


def _missing(t: Tables, store: str) -> DataFrame:
    return _active(t).join(t[store].select("image_id"), "image_id", "left_anti")


def phases(source_there: Callable[[DataFrame], DataFrame], captioned: Callable[[DataFrame], DataFrame], typed: Column, embedded: Column, text_embedded: Column, weak: bool = True, vectors: bool = True) -> list[Phase]:
    """The phases of a repair, in order.

    `source_there` keeps the rows whose source can still be read; `captioned` gives rows anew with caption_short, caption_detailed and caption_quality
    as a model answers; `typed`, `embedded` and `text_embedded` are columns of a record. `weak`: weak captions are mended too; `vectors`: so are missing
    vectors, of images that have a thumb.
    """
    quality = F.coalesce("caption_quality", F.lit("ok"))

    def reconcile(name: str) -> Phase:
        stores = ("vectors", "text_vectors", "thumbs")

        def stray(t: Tables) -> DataFrame:
            ids = t[stores[0]].select("image_id")
            for s in stores[1:]:
                ids = ids.union(t[s].select("image_id"))
            return ids.distinct().join(_active(t).select("image_id"), "image_id", "left_anti")

        return Phase(name, stray, lambda t, w: {s: t[s].join(w, "image_id", "left_anti").select(*t[s].columns) for s in stores}, stores)

    def captions(name: str, which: str) -> Phase:
        return Phase(name, lambda t: _active(t).where(quality == which), lambda t, w: {"records": _put(t["records"], captioned(w))}, ("records",))

    def added(name: str, store: str, work: Callable[[Tables], DataFrame], column: Column) -> Phase:
        rows = lambda w: w.select("image_id", column.alias("vector")).where("vector is not null")
        return Phase(name, work, lambda t, w: {store: t[store].unionByName(rows(w))}, (store,))

    out = [
        reconcile("reconcile"),
        Phase("cache", lambda t: source_there(_missing(t, "thumbs")), lambda t, w: {"thumbs": t["thumbs"].unionByName(w.select("image_id"))}, ("thumbs",)),
        captions("captions", "failed"),
        *([captions("weak_captions", "weak")] if weak else []),
        Phase("asset_types", lambda t: _active(t).where(T.blank("asset_type")), lambda t, w: {"records": _put(t["records"], w.withColumn("asset_type", typed))}, ("records",)),
        *([added("vectors", "vectors", lambda t: _missing(t, "vectors").join(t["thumbs"].select("image_id"), "image_id", "left_semi"), embedded)] if vectors else []),
        added("text_vectors", "text_vectors", lambda t: _missing(t, "text_vectors"), text_embedded),
        reconcile("final_reconcile"),
    ]
    return out


def _tables(spark: SparkSession, tables: Tables, ledger: dict) -> Tables:
    """The tables as the committed phases left them."""
    out = dict(tables)
    for done in ledger["done"]:
        for name, path in done["wrote"].items():
            out[name] = spark.read.schema(tables[name].schema).parquet(path)
    return out


def repaired(spark: SparkSession, folder: str, tables: Tables, todo: list[Phase], before: Callable[[str], None] | None = None) -> tuple[Tables, DataFrame]:
    """Run the phases that the ledger below `folder` doesn't have: the tables after that, and (phase, name, n) of what each had to mend.

    `before` is called with every phase's name once its tables are written, before it is committed.
    """
    ledger = told(spark, folder, LEDGER) or {"done": []}
    names = [d["name"] for d in ledger["done"]]
    if names != [p.name for p in todo][: len(names)]:
        raise ValueError(f"the ledger is of another repair: {names}")
    for phase in todo[len(names) :]:
        now = _tables(spark, tables, ledger)
        place, wrote = f"{folder}/{phase.name}-{uuid.uuid4().hex}", {}
        work = phase.work(now)
        work.write.parquet(f"{place}/work")
        work = spark.read.schema(work.schema).parquet(f"{place}/work")
        n = work.count()
        if n:
            after = phase.mended(now, work)
            for name in phase.changes:
                after[name].write.parquet(f"{place}/{name}")
                wrote[name] = f"{place}/{name}"
        if before:
            before(phase.name)
        ledger["done"].append({"name": phase.name, "n": n, "wrote": wrote})
        swapped(spark, folder, ledger, LEDGER)
    rows = [(k, d["name"], d["n"]) for k, d in enumerate(ledger["done"], 1)]
    return _tables(spark, tables, ledger), spark.createDataFrame(rows, "phase int, name string, n long")
