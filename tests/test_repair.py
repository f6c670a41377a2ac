"""A repair that is stopped anywhere and begun again equals one that isn't."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import repair as R

NAMES = ["reconcile", "cache", "captions", "weak_captions", "asset_types", "vectors", "text_vectors", "final_reconcile"]


def stores(spark):
    n = spark.range(60).withColumnRenamed("id", "image_id")
    i = F.col("image_id")
    records = n.select(
        "image_id", F.concat(F.lit("deck"), (i % 7).cast("string")).alias("source_file"), F.concat(F.lit("short "), i.cast("string")).alias("caption_short"), F.lit("detailed").alias("caption_detailed"),
        F.when(i % 5 == 0, "failed").when(i % 5 == 1, "weak").when(i % 5 == 2, "ok").alias("caption_quality"), F.when(i % 3 == 0, " ").when(i % 3 == 1, "icon").alias("asset_type"), (i % 11 == 0).alias("deleted"),
    )
    vector = n.select("image_id", F.array(F.lit(1.0)).alias("vector"))
    return {"records": records, "vectors": vector.where("image_id % 4 <> 0").union(vector.limit(1).select(F.lit(900).cast("long"), "vector")), "text_vectors": vector.where("image_id % 6 <> 0"), "thumbs": n.where("image_id % 2 = 0")}


def todo(calls):
    def captioned(rows):
        calls.append("captioned")
        return rows.withColumn("caption_short", F.concat(F.lit("again "), "caption_short")).withColumn("caption_quality", F.when(F.col("image_id") % 10 == 0, "failed").otherwise("ok"))

    there = lambda rows: rows.where("source_file <> 'deck3'")
    return R.phases(there, captioned, F.lit("chart"), F.array(F.lit(2.0)), F.when(F.col("image_id") != 6, F.array(F.lit(3.0))))


def shown(tables, log):
    return {k: sorted(map(tuple, t.collect()), key=repr) for k, t in tables.items()}, [tuple(r) for r in log.orderBy("phase").collect()]


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    return shown(*R.repaired(spark, str(tmp_path_factory.mktemp("repair")), stores(spark), todo([])))


def test_all_is_mended(unbroken):
    tables, log = unbroken
    live = {i for i in range(60) if i % 11}
    assert [x[1] for x in log] == NAMES
    n = {name: k for _, name, k in log}
    thumbs = {i for i in live if i % 2 == 0 or i % 7 != 3}
    assert {r[0] for r in tables["thumbs"]} == thumbs and n["cache"] == len(thumbs) - len([i for i in live if i % 2 == 0])
    assert {r[0] for r in tables["vectors"]} == {i for i in live if i % 4 or i in thumbs}
    assert {r[0] for r in tables["text_vectors"]} == live - {6}
    for i, _, short, _, quality, kind, deleted in tables["records"]:
        assert deleted == (i % 11 == 0) and (deleted or kind.strip() if i % 3 != 2 else True)
        if not deleted and i % 5 == 0:
            assert short == f"again short {i}" and quality == ("failed" if i % 10 == 0 else "ok")
    assert n["captions"] == len([i for i in live if i % 5 == 0]) and n["weak_captions"] == len([i for i in live if i % 5 == 1]) and n["asset_types"] == len([i for i in live if i % 3 != 1])


@pytest.mark.parametrize("stop", ["reconcile", "captions", "vectors", "final_reconcile"])
def test_a_stopped_run_goes_on(spark, tmp_path, unbroken, stop):
    def dies(name):
        if name == stop:
            raise RuntimeError("stopped")

    calls, where = [], str(tmp_path)
    with pytest.raises(RuntimeError):
        R.repaired(spark, where, stores(spark), todo(calls), dies)
    begun = len(calls)
    got = shown(*R.repaired(spark, where, stores(spark), todo(calls)))
    assert got == unbroken
    assert len(calls) - begun == {"reconcile": 2, "captions": 2, "vectors": 0, "final_reconcile": 0}[stop]  # committed phases aren't repeated
    assert shown(*R.repaired(spark, where, stores(spark), todo(calls))) == unbroken
    with pytest.raises(ValueError):
        R.repaired(spark, where, stores(spark), todo(calls)[1:])


def test_a_healthy_index_writes_nothing(spark, tmp_path, unbroken):
    t = {k: v.where("image_id < 0") for k, v in stores(spark).items()}
    tables, log = shown(*R.repaired(spark, str(tmp_path), t, todo([])))
    assert all(not rows for rows in tables.values()) and [n for _, _, n in log] == [0] * 8
