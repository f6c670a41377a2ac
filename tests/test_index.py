"""The inverted index as it is built."""

from collections import Counter

from spindrift.operators import index as I


def test_words_are_counted_where_their_rows_are(spark):
    docs = spark.createDataFrame([(1, "a b a")], "id long, text string")
    assert "Exchange" not in I.postings(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()


def test_postings_of_empty_texts_portions_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(I, "COUNTED", 7)
    rows = [(1, "a b a"), (2, None), (3, ""), (4, "B b c_1 " * 20), (1, "b a a"), (5, "é x-y"), (1, "a")]
    want = Counter()
    for i, text in rows:
        words = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text or "").lower().split()
        for w in words:
            want[(w, i, len(words))] += 1
    index = I.built(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert sorted(tuple(r) for r in index.postings.select("term", "id", "dl", "tf").collect()) == sorted((*k, n) for k, n in want.items())
    assert index.size.first().n == 7
    none = I.built(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert none.postings.count() == 0 and none.terms.count() == 0 and none.size.first().n == 0
