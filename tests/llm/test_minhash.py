import hashlib
import random
from itertools import combinations

import numpy as np

from spindrift.llm import minhash as M


def word_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_jaccard(documents):
    rng = np.random.default_rng(0)
    for share in (0.1, 0.5, 0.9):
        a = rng.integers(0, 2**32, 2000, dtype=np.uint32)
        b = np.r_[a[: int(2000 * share)], rng.integers(0, 2**32, 2000 - int(2000 * share), dtype=np.uint32)]
        a, b = np.unique(a), np.unique(b)
        assert abs(M.likeness(M.signature(a), M.signature(b)) - M.jaccard(a, b)) < 0.15
    for (_, x), (_, y) in list(combinations(documents, 2))[:2000]:
        s, t = word_sets(x), word_sets(y)
        assert abs(M.jaccard(M.shingles(x or ""), M.shingles(y or "")) - (len(s & t) / len(s | t) if s | t else 1)) < 1e-9


def test_edited_equals_brute_force(spark, documents):
    rows = documents + [(documents[3][0], "tie"), (None, "first of all")]
    got = M.edited(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fingerprint int").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        s, f, g = (M.signature(M.shingles(x)) for x in (t, e, n))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), M.shown(s), M.shown(f), M.likeness(s, f), M.likeness(s, g)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_edited_small(spark):
    assert M.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = M.edited(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited) for r in only] == [(5, 4, hashlib.sha256(b"abab").hexdigest())]


def components_of(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in combinations(rows, 2):
        s, t = word_sets(x), word_sets(y)
        if not s and not t or s | t and len(s & t) / len(s | t) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {d: find(d) for d in root}


def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch):
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    chain = [(5000 + i, " ".join(base[i * 2 : 40 + i * 2])) for i in range(10)]  # each like the next, the ends unlike
    near = [(6000 + i, " ".join(x if r.random() > 0.01 else x + "z" for x in base * 2)) for i in range(40)]
    rows = documents + chain + near
    want = components_of(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, content string")
    for block in (M.BLOCK, 5):
        monkeypatch.setattr(M, "BLOCK", block)
        assert {x.doc_id: x.component_id for x in M.near_duplicates(df).collect()} == want
    assert len(set(want[d] for d, _ in documents if not (dict(documents)[d] or "").split())) == 1  # texts without words are alike
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_clashing_columns_and_a_long_text(spark):
    names = "content range tail key keys a b x y s own other".split()
    long = "word " * 60_000
    df = spark.createDataFrame([(1, long, *names), (2, long + "more", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r.doc_id: r for r in M.edited(df).collect()}
    assert got[1].n_chars == len(long) and got[None].n_chars == 0 and got[1].near_next > 0.2
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()}.keys() == {1, 2, None}
