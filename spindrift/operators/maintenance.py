"""Keeping derived tables in step: health, reconciling, upserts, repairs, blobs and jobs.

Tables are immutable files here, so a change is a new table: an anti-join and a union, never an update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def minus(a: DataFrame, b: DataFrame, id_: str = "image_id") -> DataFrame:
    return a.select(id_).distinct().join(b.select(id_).distinct(), id_, "left_anti")


def both(a: DataFrame, b: DataFrame, id_: str = "image_id") -> DataFrame:
    return a.select(id_).distinct().join(b.select(id_).distinct(), id_, "left_semi")


def any_of(*tables: DataFrame, id_: str = "image_id") -> DataFrame:
    out = tables[0].select(id_)
    for t in tables[1:]:
        out = out.union(t.select(id_))
    return out.distinct()


def sets(active: DataFrame, deleted: DataFrame, visual: DataFrame, text: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, image_id): what is missing, orphaned or stale in each derived store.

    One full picture of all ids by a union and one grouping, instead of a join for each pair of stores.
    """
    stores = {"active": active, "deleted": deleted, "visual": visual, "text": text, "index": index}
    rows = None
    for name, t in stores.items():
        r = t.select("image_id", F.lit(name).alias("store"))
        rows = r if rows is None else rows.union(r)
    has = {n: F.max((F.col("store") == n).cast("int")).alias(n) for n in stores}
    g = rows.groupBy("image_id").agg(*has.values())
    on = {n: F.col(n) == 1 for n in stores}
    kinds = {
        "missing_visual": on["active"] & ~on["visual"],
        "orphan_visual": on["visual"] & ~on["active"],
        "missing_text": on["active"] & ~on["text"],
        "orphan_text": on["text"] & ~on["active"],
        "stale_deleted": on["deleted"] & (on["visual"] | on["text"]),
        "missing_index": on["active"] & ~on["index"],
        "orphan_index": on["index"] & ~on["active"],
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return g.select("image_id", F.explode(found).alias("kind"))


def counted_with_samples(rows: DataFrame, key: str, id_: str, limit: int) -> DataFrame:
    """(key, n, ids): counts and the `limit` smallest distinct ids of each key; no key's ids are gathered beyond that."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(id_)
    # the limit on ranks is taken in every task before rows are dealt out
    least = rows.groupBy(key, id_).agg(F.lit(1)).select(key, id_).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    ids = least.groupBy(key).agg(F.sort_array(F.collect_list(id_)).alias("ids"))
    return counts.join(ids, counts[key].eqNullSafe(ids[key])).select(counts[key], "n", "ids")


def health(found: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, n, ids) with the smallest ids of each kind."""
    return counted_with_samples(found, "kind", "image_id", limit)



def reconciled(store: DataFrame, active: DataFrame) -> DataFrame:
    """A store's rows without those of ids that aren't active."""
    return store.join(active.select("image_id").distinct(), "image_id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, id_: str, version: str) -> DataFrame:
    """Old and new rows; of those with the same id, the last version."""
    rows = old.unionByName(new)
    order = Window.partitionBy(id_).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ingest_actions(incoming: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each incoming image: insert, skip, update or revive, and the id that it gets.

    Of incoming images with the same content one counts, that of the smallest name; its twins are skipped.
    """
    twin = F.row_number().over(Window.partitionBy("content_hash").orderBy("name"))
    one = existing.groupBy("content_hash").agg(F.min_by("image_id", F.struct("deleted", "image_id")).alias("image_id"), F.min("deleted").alias("deleted"))
    j = incoming.withColumn("_twin", twin).join(one, "content_hash", "left")
    action = F.when(F.col("_twin") > 1, "skip").when(F.col("image_id").isNull(), "insert").when(F.col("deleted"), "revive").otherwise("update" if force else "skip")
    return j.select(*[c for c in incoming.columns], action.alias("action"), "image_id")


def orphan_blobs(listing: DataFrame, records: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Listed objects without a record (deleted ones own their blobs still), with `too_new`; unknown ages are old enough."""
    known = records.select(F.col("image_id").alias("_id")).distinct()
    lost = listing.join(known, listing.image_id == known._id, "left_anti")
    return lost.withColumn("too_new", F.coalesce(F.col("last_modified") > now - F.make_interval(hours=F.lit(hours)), F.lit(False)))


def sources_to_delete(images: DataFrame, doomed: DataFrame) -> DataFrame:
    """Source files that no image outside the doomed ones uses."""
    d = doomed.select(F.col("image_id").alias("_d")).distinct()
    g = images.join(d, images.image_id == d._d, "left").groupBy("source_file").agg(F.count("*").alias("uses"), F.count("_d").alias("doomed"))
    return g.where("doomed > 0 and uses = doomed").select("source_file")


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, status, at, changes) from a log (job_id, seq, status): the last status; a finished job stays as it was first finished."""
    done = F.col("status").isin("succeeded", "failed", "cancelled")
    first_end = F.min(F.when(done, F.struct("seq", "status")))
    last = F.max(F.struct("seq", "status"))
    g = log.groupBy("job_id").agg(F.coalesce(first_end, last).alias("s"), F.count("*").alias("changes"))
    return g.select("job_id", F.col("s.status").alias("status"), F.col("s.seq").alias("seq"), "changes")


def unique_names(files: DataFrame, folder: str = "folder", name: str = "name", order: str = "id") -> DataFrame:
    """Files with `unique_name`: the first keeps its name, later ones get -2, -3, ... before their extension."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext))).drop("_n")


def audited(actions: DataFrame, actor: str) -> DataFrame:
    """Rows (action, target, at, ...) as audit entries: id, actor and details as JSON."""
    details = [c for c in actions.columns if c not in ("action", "target", "at")]
    return actions.select(T.digest(F.concat_ws("|", F.lit(actor), "action", F.col("target").cast("string"), F.col("at").cast("string")), 32).alias("id"), F.lit(actor).alias("actor"), "action", "target", "at", F.to_json(F.struct(*details)).alias("details"))


def busy(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*V.BUSY))
