import re

import pytest

from spindrift.llm import decontamination as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n):
    out = []
    for doc, text in docs:
        w, gone, found = words(text), set(), []
        for item, itext in items:
            v = words(itext)
            wins = {tuple(v[i : i + n]) for i in range(max(1, len(v) - n + 1))} if v else set()
            at = [(i, len(x)) for x in wins for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x]
            if at:
                found.append(item)
                gone |= {i + k for i, m in at for k in range(m)}
        out.append((doc, len(w), len(gone), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [(3, "short one"), (1, "The quick, brown fox jumps over the lazy dog and then rests a while."), (2, "É a b c d e f g h i j k"), (3, "short one"), (3, "Short-ONE"), (4, None), (5, "..."), (6, "x")]
DOCS = [
    (1, "intro THE QUICK BROWN FOX jumps over the lazy dog and then rests tail"),
    (2, "é a b c d e f g h i j"),
    (3, "É A B C D E F G H I J K"),
    (4, "a short one here; short\none"),
    (5, None),
    (6, ""),
    (6, ""),
    (None, "x y X"),
    (7, "quick brown fox jumps over the lazy dog and"),
    (8, "pad " * 5000 + "brown fox jumps over the lazy dog and then rests a while"),
]


@pytest.mark.parametrize("limit", [D.LIMIT, 0])
@pytest.mark.parametrize("n", [10, 4])
def test_equals_brute_force(spark, documents, n, limit):
    docs, items = DOCS + documents, ITEMS + [(9, documents[2][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, hit int")
    found = D.hits(df, spark.createDataFrame(items, "item_id long, text string"), n, limit)
    got = [(r.doc_id, r.n_words, r.n, sorted(r["items"])) for r in found.withColumn("n", D.n_hit(found.hit)).collect()]
    assert sorted(got, key=repr) == brute(docs, items, n)


def test_capitals_whose_lower_case_depends_on_their_neighbours(spark):
    docs, items = [(1, "ΑΣ." * 12), (2, "x ΟΣ'Α x")], [(1, "ΑΣ " * 12), (2, "ΟΣ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.hits(df, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n, sorted(r["items"])) for r in found.withColumn("n", D.n_hit(found.hit)).collect()]
    assert sorted(got) == brute(docs, items, D.N) == [(1, 12, 12, [1]), (2, 4, 1, [2])]


@pytest.mark.parametrize("limit", [D.LIMIT, 0])
def test_equal_items_string_ids_and_clashing_columns(spark, limit):
    text = "the quick brown fox jumps over the lazy dog and then rests"
    names = "_row _low _w _hit w p k l id x win i is n_words items rest".split()
    df = spark.createDataFrame([(1, text, *names), (2, "clean", *names), (2, "clean", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    items = spark.createDataFrame([("a", text), ("a", text), ("b", text.upper() + "!"), ("c", "else")], "item_id string, text string")
    found = D.hits(df, items, limit=limit)
    assert sorted(((r.doc_id or 0, sorted(r["items"]), r.n_words, r["_hit"]) for r in found.collect())) == [(0, [], 0, "_hit"), (1, ["a", "a", "b"], 12, "_hit"), (2, [], 1, "_hit"), (2, [], 1, "_hit")]
    left = D.decontaminated(df, items, limit=limit)
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=repr) == sorted([(2, "clean", *names)] * 2 + [(None, None, *names)], key=repr)
    cut = D.decontaminated(df, items, remove="span", limit=limit)
    assert cut.schema == df.schema and {r.doc_id: r.text for r in cut.collect()} == {1: "", 2: "clean", None: None}


def test_beyond_the_limit_only_documents_with_a_run_are_spread(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 300) for i in range(50)] + [(99, "x " + " ".join(f"v{k}" for k in range(12)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"v{k}" for k in range(11)))], "item_id long, text string")
    found, sure = D._searched(D.carried(docs), D.item_windows(items), D.N, 0)
    assert not sure and {r.doc_id: len(r.s.hit) for r in found.where("size(s.hit) > 0").collect()} == {99: 4}


def test_removal(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[1:2], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in D.decontaminated(df, items).collect()) == [0, 2, 3, 4, 5, 6, 6, 7]
    text = {r.doc_id: r.text for r in D.decontaminated(df, items, remove="span").collect()}
    assert text[1] == "intro tail" and text[2] == DOCS[1][1] and text[5] is None


def test_empty(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.hits(none, items).count() == 0
    assert [r.hit for r in D.hits(spark.createDataFrame(DOCS[:1], "doc_id long, text string"), items).collect()] == [[]]
