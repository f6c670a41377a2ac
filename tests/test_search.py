"""The composed search and the similar search against plain versions in Python."""

import math
import random

import pytest

from spindrift.functions import values as V
from spindrift.operators import search as S
from spindrift.operators.filters import Filters
from spindrift.operators.index import built


def corpus():
    r = random.Random(3)
    words = "red blue green chart table map photo slide deck logo night river".split()
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randint(3, 12)))
        v = [r.gauss(0, 1) for _ in range(6)]
        if i % 9 == 4:
            text, v = rows[i - 4][1], [x * 2 for x in rows[i - 4][2]]  # the same again
        rows.append((i, text, v, [r.gauss(0, 1) for _ in range(6)], ("pptx", "pdf", "image")[i % 3], i % 11 == 5))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    images = spark.createDataFrame(
        [(i, t, f"{t}", "", "", f"deck{i % 7}.{k}", [], k, None, None, None, f"h{t}", i * 1000, d) for i, t, v, c, k, d in rows],
        "image_id long, text string, caption_short string, caption_detailed string, scene string, source_file string, tags array<string>, source_type string, asset_type string, author string, modified_at timestamp, content_hash string, created_at long, deleted boolean",
    ).cache()
    vectors = spark.createDataFrame([(i, v) for i, t, v, c, k, d in rows], "image_id long, vector array<double>").cache()
    captions = spark.createDataFrame([(i, c) for i, t, v, c, k, d in rows], "image_id long, vector array<double>").cache()
    queries = spark.createDataFrame([(i, v, c, t) for i, t, v, c, k, d in rows[:12]], "query_id long, vector array<double>, caption_vector array<double>, text string").cache()
    index = built(images.select("image_id", "text"), "image_id", "text")
    return rows, images, vectors, captions, queries, index


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def bm25(rows, query):
    docs = {i: t.split() for i, t, *_ in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for w in docs.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else V.IDF_FLOOR * average for t, x in idf.items()}
    out = {}
    for i, w in docs.items():
        out[i] = sum(idf.get(t, 0) * w.count(t) * (V.K1 + 1) / (w.count(t) + V.K1 * (1 - V.B + V.B * len(w) / mean)) for t in query.split())
    return {i: s for i, s in out.items() if s > 0}


def top(scores, k):
    return [i for i, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def deduped(rows, order, k):
    kept = []
    for i in order:
        if len(kept) < k and not any(rows[i][1] == rows[j][1] or cosine(rows[i][2], rows[j][2]) >= V.DEDUPE_SIMILARITY for j in kept):
            kept.append(i)
    return kept


def expected(rows, query, allowed, avoid, top_k, percent, dense_k, sparse_k, sort):
    live = {r[0] for r in rows if not r[5]}
    inside = live if allowed is None else live & allowed
    pool = [r for r in rows if allowed is None or r[0] in inside]
    lanes = [top({r[0]: cosine(query[2], r[2]) for r in pool}, dense_k), top({r[0]: cosine(query[3], r[3]) for r in pool}, dense_k)]
    found = bm25(rows, query[1])
    lanes.append(top({i: s for i, s in found.items() if allowed is None or i in inside}, sparse_k))
    fused = {}
    for lane, weight in zip(lanes, (1, 1, 0)):
        for rank, i in enumerate((i for i in lane if i in live), 1):
            fused[i] = fused.get(i, 0) + weight / (60 + rank)
    fused = {i: min(1, f / (2 / 61)) for i, f in fused.items() if not any(a in rows[i][1] + " " for a in avoid)}
    kept = deduped(rows, top(fused, len(fused)), top_k)
    shown = [(i, round(fused[i] * 100)) for i in kept]
    good = [x for x in shown if x[1] >= percent]
    relaxed = percent > 0 and not good
    shown = shown if relaxed or percent <= 0 else good
    if sort == "newest":
        shown.sort(key=lambda x: -x[0])
    return [(n, i, p, relaxed) for n, (i, p) in enumerate(shown, 1)]


@pytest.mark.parametrize(
    "filters, avoid, percent, sort",
    [(None, (), 0, None), (Filters(file_types=["pptx"]), ("river",), 30, "newest"), (None, ("blue", " "), 40, None), (None, (), 100, None), (Filters(authors=["nobody"]), (), 0, None)],
)
def test_search_equals_brute_force(tables, filters, avoid, percent, sort):
    rows, images, vectors, captions, queries, index = tables
    found = S.candidates(queries, images, vectors, captions, index, filters, None, avoid, dense_k=12, sparse_k=10)
    got = {}
    for r in S.results(found, images, vectors, 6, percent, sort=sort).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.match_percent, r.relaxed))
    allowed = None if filters is None else {r[0] for r in rows if filters.file_types and r[4] in filters.file_types}
    want = {q[0]: expected(rows, q, allowed, [a for a in avoid if a.strip()], 6, percent, 12, 10, sort) for q in rows[:12]}
    assert got == {q: w for q, w in want.items() if w}
    assert got or filters and filters.authors


def test_short_queries_have_larger_pools(spark, tables):
    rows, images, vectors, captions, _, index = tables
    asked = [(i, " ".join(t.split()[: 2 if i % 2 else 3]), v, c) for i, t, v, c, *_ in rows[:8]]
    queries = spark.createDataFrame([(i, v, c, t) for i, t, v, c in asked], "query_id long, vector array<double>, caption_vector array<double>, text string")
    got = {}
    for r in S.results(S.candidates(queries, images, vectors, captions, index, dense_k=5, sparse_k=4, short_k=20), images, vectors, 30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.match_percent, r.relaxed))
    sizes = {i: (20, 20) if i % 2 else (5, 4) for i, *_ in asked}
    assert got == {q[0]: expected(rows, q, None, [], 30, 0, *sizes[q[0]], None) for q in asked}


@pytest.mark.parametrize("axis", V.AXIS_WEIGHTS)
def test_similar_equals_brute_force(tables, axis):
    rows, images, vectors, _, queries, index = tables
    got = {}
    for r in S.similar(queries.select("query_id", "vector", "text"), images, vectors, index, axis, top_k=5, min_percent=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.match_percent))
    a, b = V.AXIS_WEIGHTS[axis]
    live = {r[0] for r in rows if not r[5]}
    for q in rows[:12]:
        visual = [i for i in top({r[0]: cosine(q[2], r[2]) for r in rows if r[0] in live}, 25) if i != q[0]]
        pool = [i for i in top({i: s for i, s in bm25(rows, q[1]).items() if i in live}, V.RERANK_N) if i != q[0]]
        asked = set(q[1].split())
        text = top({i: len(asked & set(rows[i][1].split())) / len(asked) for i in pool}, 5)
        fused = {}
        for lane, w in ((visual, a), (text, b)):
            for rank, i in enumerate(lane, 1):
                fused[i] = fused.get(i, 0) + w / (60 + rank)
        total = (a if visual else 0) + (b if text else 0)
        kept = deduped(rows, top(fused, 25), 5)
        assert got[q[0]] == [(i, p) for i in kept for p in [round(min(1, fused[i] / (total / 61)) * 100)] if p >= 10]


@pytest.mark.parametrize("sizes", [{}, {"ASKED": 5, "DOCUMENTS": 16, "SCORED": 40, "TRAVELLING": 3}])
def test_many_queries_equal_one_at_a_time(spark, tables, monkeypatch, sizes):
    """A posting is dealt out once, whatever the number of queries that ask for its term."""
    from spindrift.operators import index as I
    from spindrift.operators import knn as K

    for name, n in sizes.items():
        monkeypatch.setattr(I, name, n)
    monkeypatch.setattr(K, "BLOCK", 5)
    rows, images, _, _, queries, index = tables
    asked = queries.union(queries.selectExpr("query_id + 100", "vector", "caption_vector", "concat('red red ', text)"))
    only = images.where("image_id % 3 <> 0").selectExpr("image_id as id")
    for inside in (None, only):
        got = I.bm25(index, asked, 4, only=inside)
        shown = sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in got.collect())
        want = []
        allowed = {r[0] for r in rows if inside is None or r[0] % 3}
        for q in asked.collect():
            scores = {i: x for i, x in bm25(rows, q.text).items() if i in allowed}
            want += [(q.query_id, n, i, round(scores[i], 8)) for n, i in enumerate(top(scores, 4), 1)]
        assert shown == sorted(want)


def test_postings_do_not_multiply_with_queries(spark):
    from spindrift.operators.index import bm25 as lane

    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4))) for i in range(3000)], "id long, text string")
    index = built(docs, "id", "text")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    def cost(n):
        asked = spark.createDataFrame([(q, "a b c d") for q in range(n)], "query_id long, text string")
        before = shuffled()
        assert lane(index, asked, 5).count() == 5 * n
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return shuffled() - before

    assert cost(200) < 3 * cost(10)
