"""Operators on small literal inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import analytics as A
from spindrift.operators import filters as P
from spindrift.operators import maintenance as M
from spindrift.operators import retrieval as R
from spindrift.operators.clusters import clusters
from spindrift.operators.knn import hubness, knn
from spindrift.operators.metric import similar_pairs
from spindrift.operators.ordering import numbered
from spindrift.plans import QUERIES
from spindrift.sources import events, files, snapshots
from spindrift.streaming import admission
from tests.oracle import SMALL

VECTORS = "id long, vector array<double>"


def lane(spark, rows):
    return R.ranked(spark.createDataFrame([(0, i, float(s)) for i, s in rows], "query_id long, id long, score double"))


def test_fusion(spark):
    visual, text, sparse = lane(spark, [(1, 0.9), (2, 0.8), (3, 0.7)]), lane(spark, [(3, 0.95), (1, 0.5), (4, 0.4)]), lane(spark, [(9, 5)])
    f = {r.id: r for r in R.rrf([("dense", visual, 1), ("text", text, 1), ("sparse", sparse, 0)]).collect()}
    assert f[1].fused > f[3].fused > f[2].fused and f[9].fused == 0 and f[9].sparse_score == 5 and f[1].weight_sum == 2
    assert f[1].fused == pytest.approx(1 / 61 + 1 / 62)
    heavy = {w: max(R.rrf([("a", lane(spark, [(1, 1)]), w), ("b", lane(spark, [(2, 1)]), 2 - w)]).collect(), key=lambda r: r.fused).id for w in (0.35, 1.65)}
    assert heavy == {0.35: 2, 1.65: 1}


@pytest.mark.parametrize("kind,raw,want", [("rerank", [0.12, 0.25, 0.95, 0.27, 0.45, 0.90, 0.87, -0.1, 1.5], [10, 28, 100, 31, 54, 97, 94, 0, 100]), ("dense", [0.35, 0.92], [40, 100]), ("fusion", [0.5, 1.0, 0.0], [50, 100, 0])])
def test_match_percent(spark, kind, raw, want):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(raw)], "i int, x double")
    assert [r.p for r in df.select("i", T.match_percent(F.col("x"), F.lit(kind)).alias("p")).orderBy("i").collect()] == want


def test_hubness(spark):
    v = [(1, [1.0, 0.05, 0.0]), (2, [1.0, 0.0, 0.05]), (3, [0.98, 0.02, 0.02]), (4, [0.0, 0.0, 1.0])]
    r = {x.id: x.r for x in hubness(spark.createDataFrame(v, VECTORS), 2).collect()}
    m = np.array([x for _, x in v])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    assert [r[i] for i in (1, 2, 3, 4)] == pytest.approx(np.sort(s, axis=1)[:, -2:].mean(axis=1).tolist()) and r[1] > r[4]
    assert [x.r for x in hubness(spark.createDataFrame(v[:1], VECTORS), 10).collect()] == [0.0]
    one = spark.createDataFrame([(0.6, 0.7), (0.55, 0.2), (0.5, None)], "s double, r double").select(R.hubness_adjusted(F.col("s"), F.col("r"), F.lit(0.4)).alias("x"))
    assert [round(x.x, 9) for x in one.collect()] == [0.45, 0.65, 0.5]


def pool(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, rank int, content_hash string, vector array<double>, tier int")


def test_greedy_dedupe(spark):
    near = [0.99 / math.hypot(0.99, 0.14), 0.14 / math.hypot(0.99, 0.14), 0.0]
    rows = [
        (1, 1, 1, "h", [1.0, 0, 0], 0), (1, 2, 2, "h", [0.0, 1, 0], 0),
        (2, 1, 1, "a", [1.0, 0, 0], 0), (2, 2, 2, "b", near, 0),
        (3, 1, 1, "a", [1.0, 0, 0], 0), (3, 2, 2, "b", None, 0),
        (4, 1, 1, "x", None, 0), (4, 2, 2, "x", None, 0), (4, 3, 3, "c", None, 0), (4, 4, 4, "d", None, 1), (4, 5, 5, "e", None, 1),
        (5, 1, 1, "x", None, 1),
    ]
    rows = [(q, i, r, h, None if v is None else [float(x) for x in v], t) for q, i, r, h, v, t in rows]
    got = {}
    for r in R.greedy_dedupe(pool(spark, rows), 3).orderBy("query_id", "kept_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [1], 2: [1], 3: [1, 2], 4: [1, 3, 4]}


def test_greedy_dedupe_query_equals_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in df]), np.array([r.embedding for r in df], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["v16_greedy_dedupe"](spark, SMALL).orderBy("query_id", "kept_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in ids[ids % 100 == 0].tolist():
        s = np.round(m @ m[list(ids).index(q)], 9)
        order = np.lexsort((ids, -s))[:60]
        kept = []
        for i in order:
            if len(kept) == 20:
                break
            if all(m[i] @ m[k] < 0.3 and (text.get(ids[i]) is None or text.get(ids[i]) != text.get(ids[k])) for k in kept):
                kept.append(i)
        assert got[q] == ids[kept].tolist()


def test_greedy_dedupe_queries_grow_with_the_table(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()}
    got = {r.query_id for r in QUERIES["v16_greedy_dedupe"](spark, SMALL).collect()}
    assert got == {i for i in ids if i % 100 == 0} and max(got) >= 100


def test_blocks_equal_carried_queries(spark, monkeypatch):
    from spindrift.operators import knn as K

    monkeypatch.setattr(K, "BLOCK", 7)
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)] + [(99, None)], VECTORS)
    a, b = (sorted(map(tuple, knn(v, v, 4, exclude_self=True, carried=c).select("query_id", "id", "rank").collect())) for c in (100, 0))
    assert a == b and len(a) == 160
    pairs = {(r.a, r.b) for r in similar_pairs(v, 0.3).collect()}
    rows = {r.id: np.array(r.vector) for r in v.where("vector is not null").collect()}
    assert pairs == {(i, j) for i in rows for j in rows if i < j and rows[i] @ rows[j] / np.linalg.norm(rows[i]) / np.linalg.norm(rows[j]) >= 0.3}


def test_clusters(spark):
    chain = [(i, i + 1, 0.96) for i in range(1, 40)] + [(100, 101, 0.99)]
    got = {r.cluster_id: r for r in clusters(spark.createDataFrame(chain, "a long, b long, score double")).collect()}
    assert got[1].ids == list(range(1, 41)) and got[100].size == 2 and got[100].max_similarity == 0.99 and set(got) == {1, 100}


def test_case_metrics(spark):
    ranked = spark.createDataFrame([(1, i, r) for r, i in enumerate("abcd", 1)], "case_id int, id string, rank int")
    m = A.case_metrics(ranked, spark.createDataFrame([(1, "b", 0), (1, "z", 1), (2, "q", 0)], "case_id int, id string, pos int"), (1, 3)).orderBy("case_id").collect()
    assert (m[0].hit_1, m[0].hit_3, m[0].recall_3, m[0].mrr) == (False, True, 0.5, 0.5) and m[1].mrr == 0
    listed = A.case_metrics(ranked, spark.createDataFrame([(1, "d", 0), (1, "a", 1)], "case_id int, id string, pos int"), (1,)).first()
    assert listed.mrr == 0.25 and listed.mrr_best == 1.0


def test_kpis(spark):
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(1, t, 0, None), (2, t, 3, 0.1), (3, t, 3, 0.9)], "id long, created_at timestamp, result_count long, top_score double")
    i = spark.createDataFrame([(9, 3, t, 7)], "id long, search_event_id long, created_at timestamp, image_id long")
    k = A.kpis(s, i).first()
    assert (k.total_searches, k.zero_result_count, k.weak_result_count, k.searches_with_results, k.no_interaction_count, k.interaction_count) == (3, 1, 1, 2, 1, 1)
    assert A.kpis(s.limit(0), i.limit(0)).first().zero_result_rate == 0.0
    d = A.daily(s, i).first()
    assert (d.searches, d.interactions, d.no_interaction) == (3, 1, 1)


def test_health(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id long")
    found = {r.kind: r.ids for r in M.health(M.sets(ids(1, 2, 3), ids(9), ids(2, 3, 9, 50), ids(1, 2, 3), ids(1, 2, 3))).collect()}
    assert found == {"missing_visual": [1], "orphan_visual": [9, 50], "stale_deleted": [9]}


def test_ingest_actions(spark):
    new = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2"), ("d", "h3")], "name string, content_hash string")
    old = spark.createDataFrame([(5, "h2", False), (6, "h3", True)], "image_id long, content_hash string, deleted boolean")
    assert {r.name: (r.action, r.image_id) for r in M.ingest_actions(new, old).collect()} == {"a": ("insert", None), "b": ("skip", None), "c": ("skip", 5), "d": ("revive", 6)}
    assert {r.name: r.action for r in M.ingest_actions(new, old, force=True).collect()}["c"] == "update"


def test_metadata_filter(spark):
    i = spark.createDataFrame([(1, "photo", "a/b.png", "image"), (2, "chart", "a/c.png", "image"), (3, None, "a/d.png", "image")], "image_id long, asset_type string, source_file string, source_type string")
    assert [r.image_id for r in P.metadata_filter(i, P.Filters(asset_types=["photo"])).collect()] == [1]
    assert P.allowed(i, P.Filters(), []) is None
    with pytest.raises(ValueError):
        P.quality_filter(i, "great")


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.index_tokens(F.lit("Hello World-2024!"))) == ["hello", "world", "2024"]
    assert [one(T.normalize_tag(F.lit(x))) for x in (" Stories  of ", "stories", "series", "glass", "news", "Charts", "bus", "ties")] == ["stories of", "story", "sery", "glass", "news", "chart", "bus", "tie"]
    assert [one(T.asset_type(F.lit(x))) for x in ("Flow_Chart", "quarterly bar chart slide", None, "  ", "weird", "MAP")] == ["diagram", "chart", "other", "other", "other", "map"]
    assert one(T.truncated(F.lit(" " + "ab " * 30), 10)) == "ab ab a..."
    assert one(T.fenced(F.lit("x</data>y"))) == "<data>\nx<\\/data>y\n</data>"
    assert one(T.slide_text(F.lit(" a \r\n\r\n\n\n b "))) == "a\n\nb"
    assert one(R.implied_type(F.lit("bar graphs"))) == "chart" and one(R.implied_type(F.lit("charts maps"))) is None
    assert one(T.lenient_json(F.lit("text {\"a\": {\"b\": 1}} tail"))) == '{"a": {"b": 1}}'


def test_unknown_sort(spark):
    with pytest.raises(ValueError):
        R.sort_keys("best")


def test_numbered(spark):
    rows = [(i * 37 % 101, i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "k long, id long").repartition(5), ["k", "id"], "n").orderBy("n").collect()
    assert [(r.k, r.id, r.n) for r in got] == [(*x, n) for n, x in enumerate(sorted(rows), 1)]


def test_admission_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s))) for i, (k, s) in enumerate(zip(r.integers(0, 3, 400), np.sort(r.integers(0, 3000, 400))))]
    got = {x.id: x.admitted for x in admission.admitted(spark.createDataFrame(rows, "key long, id long, at timestamp"), "key", "id", "at", 5, 60).collect()}
    taken: dict = {}
    for k, i, t in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        recent = [u for u in taken.get(k, []) if (t - u).total_seconds() <= 60]
        assert got[i] == (len(recent) < 5)
        if len(recent) < 5:
            taken.setdefault(k, []).append(t)


def test_hooks_are_deterministic(spark):
    a, b = (sorted(map(str, QUERIES["u01_embedding_hook"](spark, SMALL).collect())) for _ in range(2))
    assert a == b and len(a) == 200


def test_event_log(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, t, "view", 1, 2, 0.5, 0), (1, t, "view", 1, 2, 0.9, 1), (2, t + dt.timedelta(days=3), "view", 1, 0, None, 0)]
    e = spark.createDataFrame(rows, "id long, created_at timestamp, search_kind string, user_id long, result_count long, top_score double, version int")
    events.write(e, f"{tmp_path}/log")
    (tmp_path / "log/dt=2024-01-01/bad.json").write_text("{not json\n")
    assert {r.id: r.top_score for r in events.read(spark, f"{tmp_path}/log").collect()} == {1: 0.9, 2: None}
    assert [r.id for r in events.read(spark, f"{tmp_path}/log", since="2024-01-02").collect()] == [2]
    pointers = e.select("id", F.to_date("created_at").alias("dt")).distinct()
    assert [r.id for r in events.lookup(spark, f"{tmp_path}/log", pointers, spark.createDataFrame([(2,)], "id long")).collect()] == [2]


def test_files(spark, tmp_path):
    for n in ("a.png", "sub/b.PPTX", "c.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"data")
    found = files.corpus(spark, str(tmp_path))
    assert sorted(r.suffix for r in found.collect()) == ["png", "pptx"]
    assert [(r.source_type, bytes(r.picture)) for r in files.extracted(found.where("suffix = 'png'")).collect()] == [("image", b"data")]
    assert sorted(r.image_id for r in files.ids_of(files.corpus(spark, str(tmp_path), content=False)).collect()) == ["a", "b"]


def test_snapshots(spark, tmp_path):
    a = spark.range(5)
    snapshots.snapshot({"t": a}, str(tmp_path / "s"), "one", "2024-01-01")
    snapshots.snapshot({"t": a.limit(2)}, str(tmp_path / "s"), "two", "2024-01-02")
    assert [r.label for r in snapshots.choice(spark, str(tmp_path / "s"), 3).collect()] == ["one"]
    assert snapshots.restore(spark, str(tmp_path / "s"), "one")["t"].count() == 5
    c = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, result string, at int")
    got = snapshots.cached(spark.createDataFrame([("k",), ("q",)], "key string"), c, "key", F.lit("none")).collect()
    assert {r.key: r.result for r in got} == {"k": "new", "q": "none"}


def test_blocks_of_few_numbers_and_what_they_shuffle(spark, monkeypatch):
    from spindrift.operators import knn as K

    monkeypatch.setattr(K, "BLOCK", 10)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 6))
    m[::7] = m[0]  # ties go to the smaller id
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], VECTORS).cache()
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    def cost(n):
        some, before = v.where(f"id < {n}"), shuffled()
        knn(some, some, 3, exclude_self=True, carried=0).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return shuffled() - before

    assert cost(400) < 8 * cost(100)
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    score = np.round(u @ u.T, 9)
    np.fill_diagonal(score, -np.inf)
    want = [(i, int(j), n) for i in range(400) for n, j in enumerate(np.lexsort((np.arange(400), -score[i]))[:3], 1)]
    monkeypatch.setattr(K, "HELD", 90 * 6)
    monkeypatch.setattr(K, "ROWS", 32)
    monkeypatch.setattr(K, "COLUMNS", 50)
    assert sorted(tuple(r) for r in knn(v, v, 3, exclude_self=True, carried=0).select("query_id", "id", "rank").collect()) == sorted(want)
