import zlib
from collections import defaultdict

import pytest

from spindrift.llm import sharding as S
from spindrift.llm.queries import op13_sharding


def test_items_go_to_the_least_loaded():
    items = [(s, f"{k:02}") for k, s in enumerate([9, 7, 7, 5, 4, 4, 3, 1])]
    loads, want = [0] * 3, {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        k = loads.index(min(loads))
        want[name] = k
        loads[k] += size
    assert S.lpt(items, 3) == want
    assert max(loads) - min(loads) <= 1


ROWS = [(i, "x" * (i * 7 % 301), "s", i) for i in range(600)] + [(i, "the same text, many times", "t", 0) for i in range(400)] + [(7, None, "u", 1), (7, None, "u", 1), (None, "é", "u", 1), (None, None, None, None), (8, "", "v", 2)]
SCHEMA = "doc_id long, text string, shard string, slot int"


@pytest.mark.parametrize("shards, grain", [(24, 1000), (5, 3), (1, 10)])
def test_shards_are_even_and_keep_groups(spark, shards, grain):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(7)
    rows = S.sharded(df, shards, grain).collect()
    assert sorted(((r.doc_id, r.text, r.rest.shard, r.rest.slot) for r in rows), key=repr) == sorted(ROWS, key=repr)
    homes, slots, loads, groups = defaultdict(set), defaultdict(list), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8 and 0 <= r.shard < shards
        homes[r.text or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[r.text or ""] += r.size
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    # no shard is larger than its share and one item more: the largest group or a bundle
    total = sum(loads.values())
    assert max(loads.values()) <= total / shards + max(max(groups.values()), 4 * total / (shards * grain))
    if grain == 1000:
        rest = [loads[k] for k in range(shards) if k not in homes["the same text, many times"]]
        assert max(rest) - min(rest) <= 0.05 * total / shards


def test_the_same_at_any_partitioning(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a, b = ({(r.text, r.shard) for r in S.placed(df.repartition(n).select("doc_id", "text"), 6, 20).collect()} for n in (1, 9))
    assert a == b


def test_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    back = S.written(df, str(tmp_path / "shards"), 4)
    assert back.count() == len(ROWS) and {r.shard for r in back.select("shard").distinct().collect()} == set(range(4))


def test_query_and_empty_table(spark, tmp_path):
    (spark.createDataFrame(ROWS, SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    for r in op13_sharding(spark, str(tmp_path)).collect():
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    texts = {(r.doc_id, r.text_crc32) for r in op13_sharding(spark, str(tmp_path)).collect()}
    assert texts == {(i, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS}
    assert S.sharded(spark.createDataFrame([], SCHEMA)).count() == 0
