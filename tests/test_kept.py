"""Stores in segments against what is built anew, metric pruning against all pairs, quantiles against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import metric
from spindrift.operators import quantiles as Q
from spindrift.operators.index import bm25, built
from spindrift.operators.kept import KeptIndex, KeptNeighbours
from spindrift.operators.knn import hubness, knn
from spindrift.sources import segments

WORDS = "red green blue chart table icon map photo of the a".split()
DOCS, VECTORS = "id long, text string", "id long, vector array<double>"


def same_index(index, want):
    terms = lambda i: sorted((r.term, r.df, r.tf, round(r.idf, 9)) for r in i.terms.collect())
    posted = lambda i: sorted(tuple(r) for r in i.postings.select("term", "id", "tf", "dl").collect())
    assert terms(index) == terms(want) and posted(index) == posted(want)
    assert [round(x, 9) for x in index.size.select("n", "avgdl").first()] == [round(x, 9) for x in want.size.select("n", "avgdl").first()]


def test_index_equals_a_rebuild_after_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST", 3)
    r, now = random.Random(3), {}
    for step in range(5):
        new = {r.randrange(40): r.choice([None, "", " ".join(r.choices(WORDS, k=r.randint(1, 9)))]) for _ in range(12)}
        gone = [i for i in r.sample(range(60), 6) if i not in new]
        now = {i: t for i, t in (now | new).items() if i not in gone}
        KeptIndex(spark, str(tmp_path)).changed(spark.createDataFrame(list(new.items()), DOCS), spark.createDataFrame([(i,) for i in gone], "id long"))
    kept = KeptIndex(spark, str(tmp_path))
    assert len(kept.docs.parts) <= 3 and not kept.broken()
    same_index(kept.index(), built(spark.createDataFrame(list(now.items()), DOCS), "id", "text"))
    kept.changed(deleted=spark.createDataFrame([(i,) for i in now], "id long"))
    assert kept.index().postings.count() == 0 and kept.index().terms.count() == 0


def test_broken_and_half_written_indexes_are_empty_and_told(spark, tmp_path):
    where = str(tmp_path)
    q = spark.createDataFrame([(1, "red")], "query_id long, text string")
    assert bm25(KeptIndex(spark, where).index(), q, 5).count() == 0
    kept = KeptIndex(spark, where).changed(spark.createDataFrame([(1, "red chart"), (2, "blue"), (3, "green"), (4, "map")], DOCS))
    index, wrong = KeptIndex(spark, where).index_or_empty()
    assert [x.id for x in bm25(index, q, 5).collect()] == [1] and wrong == []
    before = segments.told(spark, f"{where}/documents")
    kept.changed(spark.createDataFrame([(5, "red")], DOCS))
    segments.swapped(spark, f"{where}/documents", before)  # as if the change had stopped between its two stores
    assert KeptIndex(spark, where).index().postings.count() == 0
    segments.swapped(spark, f"{where}/documents", {"parts": kept.docs.parts, "facts": kept.docs.facts})
    name = kept.docs.parts[0]["name"]
    for f in (tmp_path / "documents" / name / "postings").glob("*.parquet"):
        f.write_bytes(b"damaged")
    index, wrong = KeptIndex(spark, where).index_or_empty()
    assert index.postings.count() == 0 and [(s, t) for s, t, _ in wrong] == [(name, "postings")]


def test_a_reader_keeps_its_state_and_old_segments_are_swept(spark, tmp_path):
    schemas = {"rows": "id long, x string"}
    s0 = segments.Segments.opened(spark, str(tmp_path), schemas)
    rows = lambda *x: {"rows": spark.createDataFrame(list(x), schemas["rows"])}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    s1 = s0.changed(rows((1, "a"), (2, "b")), ids(1, 2))
    s2 = s1.changed(rows((2, "c"), (2, "d")), ids(2, 3))
    s3 = s2.changed(rows(), ids(1))
    live = lambda s: sorted(tuple(r) for r in s.live("rows").collect())
    assert (live(s0), live(s1), live(s2), live(s3)) == ([], [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (2, "d")], [(2, "c"), (2, "d")])
    again = segments.Segments.opened(spark, str(tmp_path), schemas)
    assert live(again) == live(s3) and [tuple(r) for r in again.of("rows", ids(2, 9)).collect()] == [(2, "c"), (2, "d")]
    one = again.merged()
    assert len(one.parts) == 1 and live(one) == live(s3)  # both can be read until the old one is swept
    assert one.swept() == sorted(p["name"] for p in s3.parts) and live(segments.Segments.opened(spark, str(tmp_path), schemas)) == live(one) == [(2, "c"), (2, "d")]


def test_a_pointer_that_is_being_replaced(spark, tmp_path):
    where = str(tmp_path)
    assert segments.told(spark, where) is None
    segments.swapped(spark, where, {"n": 1})
    (tmp_path / "_current.json.half").write_text('{"n": 3')
    assert segments.told(spark, where) == {"n": 1}
    # the writer deleted the old one and stopped before the rename
    (tmp_path / "current.json").unlink()
    assert segments.told(spark, where) is None
    (tmp_path / "_current.json.whole").write_text('{"n": 2}')
    assert segments.told(spark, where) == {"n": 2}
    segments.swapped(spark, where, {"n": 4})
    assert segments.told(spark, where) == {"n": 4}


def vectors(rng, n, dim=6):
    v = rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.3
    v[rng.random(n) < 0.1] = v[0]  # copies
    return v


def test_neighbours_equal_a_rebuild_after_changes(spark, tmp_path):
    rng = np.random.default_rng(2)
    now = {}
    kept = KeptNeighbours(spark, str(tmp_path), 4)
    for step, many in enumerate((60, 10, 1, 0, 25)):
        ids = [int(i) for i in rng.choice(90, many, replace=False)]
        new = dict(zip(ids, vectors(rng, max(many, 1)).tolist()))
        if step == 2:
            new[ids[0]] = [0.0] * 6
        gone = [int(i) for i in rng.choice(90, 8 if step else 0, replace=False) if int(i) not in new]
        now = {i: v for i, v in (now | new).items() if i not in gone}
        kept.changed(spark.createDataFrame(list(new.items()), VECTORS), spark.createDataFrame([(i,) for i in gone], "id long"))
    df = spark.createDataFrame(list(now.items()), VECTORS)
    shown = lambda rows: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in rows.collect())
    again = KeptNeighbours(spark, str(tmp_path), 4)
    assert shown(again.neighbours()) == shown(knn(df, df, 4, exclude_self=True))
    r = {x.id: x.r for x in hubness(df, 4).collect()}
    got = {x.id: x.r for x in again.hubness().collect()}
    assert got.keys() == r.keys() and all(abs(got[i] - r[i]) < 1e-9 for i in r)
    assert abs(again.mean() - sum(r.values()) / len(r)) < 1e-9


def test_a_change_writes_the_lists_that_it_touches(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = np.repeat(np.eye(20), 10, axis=0) + rng.normal(size=(200, 20)) * 0.01
    kept = KeptNeighbours(spark, str(tmp_path), 3).changed(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS))
    assert kept.store.facts["written"] == 200
    kept.changed(spark.createDataFrame([(500, v[0].tolist())], VECTORS), spark.createDataFrame([(199,)], "id long"))
    assert kept.store.facts["written"] <= 20  # the cluster that gains a row and the one that loses one


def test_few_and_no_vectors(spark, tmp_path):
    kept = KeptNeighbours(spark, str(tmp_path), 3)
    assert kept.neighbours().count() == 0 and kept.mean() is None
    kept.changed(spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], VECTORS))
    assert [tuple(r) for r in kept.hubness().collect()] == [(1, 0.0)]
    kept.changed(deleted=spark.createDataFrame([(1,)], "id long"))
    assert kept.hubness().count() == 0


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.05])
def test_metric_pruning_finds_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(metric, "CELL", 30)
    monkeypatch.setattr(metric, "BLOCK", 40)
    rng = np.random.default_rng(7)
    v = vectors(rng, 400)
    v[5] = 0
    v[6] = 3 * v[7]
    n = np.sqrt((v * v).sum(1, keepdims=True))
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    i, j = np.nonzero(np.triu(np.round(u @ u.T, 9) >= threshold, 1))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [])], VECTORS)
    seen = spark.sparkContext.accumulator(0)
    got = [(r.a, r.b) for r in metric.similar_pairs(df, threshold, compared=seen).collect()]
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist()))
    if threshold == 0.95:
        assert seen.value < 400 * 399 / 2 / 4
    edges = [(r.a, r.b) for r in metric.similar_classes(df, threshold).collect()]
    assert classes(edges) == classes(got) and len(edges) < len(got)


def classes(edges):
    home = {}
    for a, b in edges:
        x, y = home.setdefault(a, {a}), home.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                home[k] = x
    return {frozenset(x) for x in home.values()}


def test_no_vectors_no_pairs(spark):
    assert metric.similar_pairs(spark.createDataFrame([], VECTORS), 0.9).count() == 0
    assert metric.similar_pairs(spark.createDataFrame([(1, [1.0])], VECTORS), 0.9).count() == 0
    with pytest.raises(ValueError):
        metric.similar_pairs(spark.createDataFrame([(1, [1.0]), (2, [2.0])], VECTORS), 0.0)


@pytest.mark.parametrize("few", [1000, 5])
def test_quantiles_equal_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(1)
    rows = [("normal", float(x)) for x in rng.normal(size=3000)] + [("one value", 7.5)] * 500 + [("few", float(x)) for x in rng.integers(-2, 3, 500)]
    rows += [("wide", float(10**x)) for x in rng.uniform(-30, 30, 800)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 4.0), (None, -4.0), ("none", None), ("none", float("nan")), ("zero", -0.0), ("zero", 0.0)]
    df = spark.createDataFrame(rows, "step string, sec double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.step, r.share): r["quantile"] for r in Q.quantiles(df, "step", "sec", shares).collect()}
    want = df.where("sec is not null and not isnan(sec)").groupBy("step").agg(*(F.percentile("sec", F.lit(s)).alias(str(s)) for s in shares)).collect()
    assert len(got) == 5 * (len(want))
    for r in want:
        for s in shares:
            assert got[r.step, s] == pytest.approx(r[str(s)], rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("block", [2_000, 7])
def test_blocks_meet_where_pruning_rules_out_little(spark, monkeypatch, block):
    """Rows aren't copied to every cell, and a task tells what connects its rows instead of all their pairs."""
    from spindrift.operators import knn as K

    monkeypatch.setattr(metric, "CELL", 10)
    monkeypatch.setattr(metric, "COPIES", 2)
    monkeypatch.setattr(K, "HELD", 90 * 6)
    monkeypatch.setattr(K, "BLOCK", block)
    rng = np.random.default_rng(3)
    v = vectors(rng, 300)
    n = v / np.sqrt((v * v).sum(1, keepdims=True))
    score = n @ n.T
    i, j = np.nonzero(np.triu(np.round(score, 9) >= 0.4, 1))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], VECTORS)
    monkeypatch.setattr(metric, "held_then_passed", None)  # no cells
    got = [(r.a, r.b) for r in metric.similar_pairs(df, 0.4).collect()]
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist()))
    edges = metric.similar_classes(df, 0.4).collect()
    assert classes([(r.a, r.b) for r in edges]) == classes(got) and len(edges) < len(got) / 4
    best = lambda es: {c: max(s for a, b, s in es if a in c) for c in classes([e[:2] for e in es])}
    want = best([(a, b, round(float(score[a, b]), 8)) for a, b in got])
    assert best([(r.a, r.b, round(r.score, 8)) for r in edges]) == want
