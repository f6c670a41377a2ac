"""Sessions against a store that is kept event by event."""

import datetime as dt
import random

import numpy as np
import pytest

from spindrift.streaming import lru

START = dt.datetime(2024, 1, 1)


def model(rows, limit, ttl):
    """The store itself, one event after another."""
    store, out = {}, {}
    for at, i, key in sorted((at, i, key) for i, key, at in rows):
        out[i] = key not in store
        if out[i]:
            if ttl > 0:
                store = {k: t for k, t in store.items() if (at - t).total_seconds() <= ttl}
            if limit > 0 and len(store) > limit:
                for k, _ in sorted(store.items(), key=lambda x: x[1])[: len(store) - limit]:
                    del store[k]
        store.pop(key, None)
        store[key] = at
    return out


def events(seed, n, keys, pause):
    r, at, rows = random.Random(seed), START, []
    for i in range(n):
        at += dt.timedelta(microseconds=r.randrange(1, 2_000_000 * pause))
        rows.append((i * 7 % 10_007, min(int(r.expovariate(4 / keys)), keys - 1), at))
    return rows


@pytest.mark.parametrize("n, keys, limit, ttl, pause", [(3000, 60, 10, 0, 5), (3000, 60, 10, 120, 5), (3000, 60, 0, 90, 5), (2500, 400, 100, 4000, 30), (500, 5, 1000, 7200, 5), (800, 30, 1, 40, 5), (300, 20, 0, 0, 5)])
def test_equals_the_store(spark, monkeypatch, n, keys, limit, ttl, pause):
    monkeypatch.setattr(lru, "LEAST", 50)
    rows = events(n + keys + ttl, n, keys, pause)
    df = spark.createDataFrame(rows, "id long, key long, at timestamp").repartition(3)
    got = {r.id: r.created for r in lru.created(df, "key", "at", "id", limit, ttl).collect()}
    want = model(rows, limit, ttl)
    assert got == want
    assert n < 2000 or sum(want.values()) > keys or not (limit or ttl)


def test_dominated_pairs():
    r = np.random.default_rng(1)
    for n, q in ((0, 3), (1, 5), (200, 100), (257, 300)):
        px, py, qx, qy = (r.integers(-1, 60, k) for k in (n, n, q, q))
        want = ((px[None, :] < qx[:, None]) & (py[None, :] <= qy[:, None])).sum(1)
        assert (lru.dominated(px, py, qx, qy) == want).all()


def test_nulls_and_none(spark):
    df = spark.createDataFrame([(1, None, START), (2, None, START), (None, 5, START), (3, 5, None)], "id long, key long, at timestamp")
    assert {(r.id, r.created) for r in lru.created(df, "key", "at", "id").collect()} == {(1, True), (2, False)}
    assert lru.created(df.limit(0), "key", "at", "id").count() == 0
