import pytest

import corpus_pipeline as C
from spindrift.llm import toxicity
from spindrift.llm.queries import tokenizer_path
from tests.llm import test_decontamination, test_simhash
from tests.llm.test_windows import prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    import random

    r = random.Random(9)
    words = "vilefool grotbag scumling".split()
    docs, labels = [], []
    for i in range(260):
        w, toxic = prose(r, r.randint(20, 120)), int(i % 4 == 0)
        if toxic:
            w[r.randrange(len(w)) : 0] = [r.choice(words)] * 2
        docs.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, 1, toxic))
    item = " ".join(prose(r, 30))
    docs += documents + [(5000, docs[1][1]), (5001, "before " + item + " after"), (None, "no id at all")]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = [docs.collect()]
    for name, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        steps.append(docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(steps[-1], docs.schema)
    rows = lambda step: sorted(((r.doc_id, r.text) for r in step), key=repr)
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "toxic as label")
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    assert rows(steps[1]) == sorted([(d, t) for d, t in rows(steps[0]) if model.score(t or "") < 0.7], key=repr)
    toxic = {r.doc_id for r in labels.where("label = 1").collect()}
    kept = {r.doc_id for r in steps[1]}
    assert len(toxic & kept) <= 2 and len({1000 + i for i in range(260)} - toxic - kept) <= 2
    first = test_simhash.brute([(d if d is not None else 10**9, t) for d, t in rows(steps[1])])
    assert {d if d is not None else 10**9 for d, _ in rows(steps[2])} == {c for _, c in first.values()}
    texts = dict(rows(steps[2]))
    for d, t in rows(steps[3]):
        assert t == texts[d] or len(t) < len(texts[d]) and t.strip()
    hit = {d: n for d, _, n, _ in test_decontamination.brute(rows(steps[3]), [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 10)}
    assert rows(steps[4]) == [(d, t) for d, t in rows(steps[3]) if not hit[d]] and 5001 in hit and hit[5001]
    from spindrift.llm.packing import word_tokenizer

    w = word_tokenizer(tokenizer_path())
    tokens = {}
    for r in steps[5]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {d: len(w.encode(t or "")) + 1 for d, t in rows(steps[4])}


def test_run_and_empty(spark, folder, tmp_path):
    assert C.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
