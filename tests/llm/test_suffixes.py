import random
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import suffixes as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((doc, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("length,gram,hot", [(200, 40, 30_000), (24, 6, 30_000), (24, 6, 3)])
def test_equals_brute_force(spark, documents, length, gram, hot):
    rows = documents + documents[:2] + [(None, documents[2][1]), (5, "abc" * 100 + "x" + "abc" * 100)]
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length, gram, hot)
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=key) == sorted(brute(rows, length), key=key)


def test_deep_shallow_sorts():
    r = random.Random(2)
    base = [bytes(r.choices(b"ab", k=96)) for _ in range(5)]
    strings, group = [], []
    for g in range(6):
        for _ in range(40):
            s = bytearray(r.choice(base))
            for _ in range(r.randint(0, 2)):
                s[r.randrange(96)] = 99
            strings.append(bytes(s))
            group.append(g)
    rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 96)
    order = S.deep_shallow(np.array(group), rows)
    got = [(group[i], strings[i]) for i in order]
    assert got == sorted(zip(group, strings))
    lcp = S.neighbours(np.array(group), rows, order)
    assert all(x[1][:n] == y[1][:n] and (n == 96 or x[1][n] != y[1][n]) for x, y, n in zip(got, got[1:], lcp[1:]) if n >= 0)


def test_empty(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0


def test_clashing_columns_and_a_long_text(spark):
    names = "row hs hot spans h left segment docs at n_bytes kept".split()
    long = "".join(f"{k} some text that does not repeat " for k in range(20_000))
    df = spark.createDataFrame([(1, long, *names), (2, "x" + long[1000:2000], *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.substring_dedup(df).collect()}
    assert got == {1: (len(long), 1000, 1), 2: (1001, 1000, 1), None: (0, 0, 0)}
