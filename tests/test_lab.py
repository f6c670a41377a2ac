"""The comparison in one plan against each variant alone, and models that fail."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.plans import lab

WORDS = "red green blue chart table icon map photo".split()


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 6)))) for i in range(80)]
    pool = [(q, i, *(round(r.choice([0.0, r.random(), 0.5]), 3) for _ in range(3))) for q in (100, 200, 300) for i in r.sample(range(80), 45)]
    asked = [(100, "red chart"), (200, "map of nothing here at all ever"), (300, "")]
    return (
        spark.createDataFrame(pool, "query_id long, id long, dense_score double, text_score double, sparse_score double"),
        spark.createDataFrame(asked, "query_id long, text string"),
        spark.createDataFrame(docs, "id long, document string"),
        dict(asked),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_every_variant_alone(spark, tables):
    pool, asked, docs, texts = tables
    got = lab.comparison(pool, asked, docs)
    assert got.where("error is not null").count() == 0
    for q, text in texts.items():
        mine = got.where(F.col("query_id") == q).select("variant", "id", "score", "rank")
        want = []
        for name in (*lab.SINGLE, *lab.FUSED):
            want += rows(lab.compared(pool.where(F.col("query_id") == q), name, text, docs))
        assert rows(mine) == sorted(want)


def test_a_failure_is_a_row_and_the_rest_is_whole(spark, tables):
    pool, asked, docs, _ = tables

    def model(query, text):
        broken = query == "red chart"
        return F.struct(F.when(~broken, F.lit(0.5)).alias("score"), F.when(broken, F.lit("no model")).alias("error"))

    got, good = lab.comparison(pool, asked, docs, model), lab.comparison(pool, asked, docs)
    needing = {n for n, (_, _, by_model) in lab.FUSED.items() if by_model}
    lost = [(r.query_id, r.variant, r.id, r.error) for r in got.where("error is not null").collect()]
    assert sorted(lost) == sorted((100, n, None, "no model") for n in needing)
    rest = lambda df: rows(df.where(~F.col("variant").isin(*needing)).drop("error"))
    assert rest(got) == rest(good)
    assert {r.variant for r in got.where("query_id = 100 and error is null").collect()} == {*lab.SINGLE, *lab.FUSED} - needing


def test_no_pool(spark, tables):
    pool, asked, docs, _ = tables
    assert lab.comparison(pool.limit(0), asked, docs).count() == 0
