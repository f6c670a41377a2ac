"""Snapshots that share chunks, and restores that fall through to an older one."""

import pytest

from spindrift.sources import segments, snapshots

ROWS = [(i, f"name {i}" if i % 5 else None, i / 3) for i in range(500)]
SCHEMA = "id long, name string, x double"


def taken(spark, rows, where, label, at):
    other = spark.createDataFrame([(1, "t")], "k long, v string")
    return snapshots.snapshot({"rows": spark.createDataFrame(rows, SCHEMA).repartition(3), "other": other}, where, label, at)


def shown(tables):
    return sorted((tuple(r) for r in tables["rows"].collect()), key=repr)


def test_only_what_changed_is_written(spark, tmp_path):
    where = str(tmp_path)
    first = taken(spark, ROWS, where, "one", "2024-01-01")
    assert first["written"] == first["chunks"] == snapshots.CHUNKS + 1
    assert taken(spark, ROWS[::-1], where, "two", "2024-01-02")["written"] == 0
    changed = [*ROWS[:7], (7, "new", 1.0), *ROWS[8:], (1000, None, None)]
    assert 1 <= taken(spark, changed, where, "three", "2024-01-03")["written"] <= 3
    for label, rows in (("one", ROWS), ("two", ROWS), ("three", changed)):
        assert shown(snapshots.restore(spark, where, label)) == sorted(rows, key=repr)


def test_damage_leads_to_the_one_before(spark, tmp_path):
    where = str(tmp_path)
    taken(spark, ROWS[:300], where, "old", "2024-01-01")
    taken(spark, ROWS[:400], where, "middle", "2024-01-02")
    taken(spark, ROWS, where, snapshots.LATEST, "2024-01-03")
    taken(spark, [], where, "empty", "2024-01-04")
    assert [r.label for r in snapshots.choice(spark, where, 0).collect()] == [snapshots.LATEST, "empty", "middle", "old"]  # the empty one has a row of the other table
    assert [r.label for r in snapshots.choice(spark, where, 350).collect()] == [snapshots.LATEST, "middle"]
    assert snapshots.restore_best(spark, where, 1)[0] == snapshots.LATEST

    def own(label):
        chunks = [segments.told(spark, f"{where}/manifests", f"{x}.json")["tables"]["rows"]["chunks"] for x in (label, "old")]
        return next(c for c in chunks[0] if c["content"] not in {o["content"] for o in chunks[1]})

    lost = own(snapshots.LATEST)
    for f in (tmp_path / "objects" / "rows" / lost["at"] / f"_content={lost['content']}").glob("*.parquet"):
        f.write_bytes(b"damaged")
    label, tables, wrong = snapshots.restore_best(spark, where, 1)
    assert label == "middle" and shown(tables) == sorted(ROWS[:400], key=repr) and len(wrong) == 1
    # rows of the right number that aren't those written
    lost = own("middle")
    folder = tmp_path / "objects" / "rows" / lost["at"] / f"_content={lost['content']}"
    back = spark.read.parquet(str(folder)).collect()
    for f in folder.iterdir():
        f.unlink()
    spark.createDataFrame([(r.id, "other", r.x) for r in back], SCHEMA).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(snapshots.Damaged):
        snapshots.restore(spark, where, "middle")
    assert snapshots.restore_best(spark, where, 1)[0] == "old"
    assert snapshots.restore_best(spark, where, 10_000) == (None, {}, [])


def test_a_snapshot_without_a_manifest_is_none(spark, tmp_path):
    taken(spark, ROWS, str(tmp_path), "one", "2024-01-01")
    (tmp_path / "manifests" / "two.json").write_text("{half")
    assert [r.label for r in snapshots.choice(spark, str(tmp_path), 0).collect()] == ["one"]
    with pytest.raises(snapshots.Damaged):
        snapshots.restore(spark, str(tmp_path), "two")
