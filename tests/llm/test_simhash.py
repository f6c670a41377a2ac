from itertools import combinations

import numpy as np
import pytest
import xxhash

from spindrift.llm import simhash as S


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    for errors in range(4):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, errors, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        keys = [set() for _ in range(len(a))], [set() for _ in range(len(a))]
        for side, fp in zip(keys, (a, b)):
            for row, key in zip(*S.keys_of(fp)):
                side[row].add(key)
        assert all(x & y for x, y in zip(*keys))


def test_golay_is_perfect():
    words = np.arange(1 << 23)
    index = S.nearest(words)
    assert (np.bincount(index) == 2048).all() and len(np.unique(index)) == 4096


def test_near_equals_brute_force():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 2**64, 30, dtype=np.uint64).repeat(200) ^ (np.uint64(1) << rng.integers(0, 64, 6000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 6000, dtype=np.uint64)))
    assert len(fp) > S.BUCKET
    a, b = S.near(fp)
    group = {int(x): int(x) for x in fp} | {int(x): int(y) for x, y in zip(a, b)}
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    c, d = S.forest(fp[x], fp[y])
    assert group == {int(v): int(v) for v in fp} | {int(v): int(w) for v, w in zip(c, d)}


def test_near_equals_brute_force_in_a_bucket_that_shares_43_bits():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.choice(1 << 21, 3000, replace=False).astype(np.uint64) << np.uint64(43) | np.uint64(0x2A5A5A5A5A5))
    assert len(fp) > S.BUCKET
    a, b = S.near(fp)
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    c, d = S.forest(fp[x], fp[y])
    assert {int(v): int(w) for v, w in zip(a, b) if v != w} == {int(v): int(w) for v, w in zip(c, d) if v != w}


def brute(rows):
    prints = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in combinations(prints, 2):
        if (x ^ y).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (x, find(i)) for i, x in prints}


@pytest.mark.parametrize("share", [S.HOT_SHARE, 100, 1])  # all, some or no fingerprints are joined by broadcast
def test_classes_equal_brute_force(spark, documents, monkeypatch, share):
    monkeypatch.setattr(S, "HOT_SHARE", share)
    rows = documents
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    assert S.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "y", 2), (3, "", None, None), (3, "", None, None)], "doc_id long, text string, fp string, component_id long")
    assert sorted((r.doc_id, r.component_id) for r in S.classes(docs).collect()) == [(1, 1), (2, 2), (3, 2), (3, 2)]
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_near_dedup_carries_columns_of_any_name_and_long_texts(spark):
    names = "_key key n rest fp component_id _text".split()
    long = "word after word " * 30_000
    rows = [(1, long), (2, long), (3, "else one two three four"), (3, "else one two three four"), (None, "no id at all"), (None, "no id at all"), (None, None)]
    df = spark.createDataFrame([(d, t, *names) for d, t in rows], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    kept = S.near_dedup(df)
    assert kept.schema == df.schema
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(d, t, *names) for d, t in (rows[0], rows[2], rows[4], rows[6])], key=repr)
    assert [r.component_id for r in S.classes(df.where("text like 'no id%'")).collect()] == [None, None]
