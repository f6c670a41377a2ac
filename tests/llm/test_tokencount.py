import random

import pytest

from spindrift.llm import tokencount as T

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["the ", " of", "é", "  ", "\n", "'s", "don't", "12", " 3", "...", "\t", "日本", " a b c d e f", "x", " ", "Привет мир", "文字。", "、", "²", "_", "\r\n", "\u00a0", "\u2003", "'"]


def test_trees_equal_encoding_anew():
    count, r = T.encoder(PATH, P.PATTERN), random.Random(1)
    for trial in range(150):
        text = "".join(r.choices(ALPHABET, k=r.randint(0, 1200)))
        tree = T.TokenTree(text, count)
        for _ in range(25):
            at, cut, put = r.randint(-3, len(text) + 5), r.choice([0, 0, 1, 2, 5, 60, 900]), "".join(r.choices(ALPHABET, k=r.choice([0, 1, 1, 3, 300])))
            tree.edit(at, cut, put)
            at = min(max(at, 0), len(text))
            text = text[:at] + put + text[at + cut :]
            assert tree.text() == text and tree.total == count(text) and tree.size == len(text)


def test_few_characters_are_encoded_again():
    count = T.encoder(PATH, P.PATTERN)
    tree = T.TokenTree("some words of a long text " * 4000, count)
    tree.encoded = 0
    tree.edit(50_000, 10, "another")
    assert 0 < tree.encoded < 4 * T.LEAF and tree.total == count(tree.text())


@pytest.mark.parametrize("text", ["Слова длинного текста и ещё ", "λέξεις ενός κειμένου  ", "很长的文字，没有空格。", "word\n", "a  b\t"])
def test_other_scripts_are_cut_too(text):
    count = T.encoder(PATH, P.PATTERN)
    tree = T.TokenTree(text * 4000, count)
    tree.encoded = 0
    tree.edit(20_000, 3, "z")
    tree.edit(9_000, 0, "some more " * 20)
    assert 0 < tree.encoded < 12 * T.LEAF and tree.total == count(tree.text())


def test_an_insertion_keeps_the_tree(monkeypatch):
    tree = T.TokenTree("some words of a long text " * 4000, T.encoder(PATH, P.PATTERN))
    built = []
    monkeypatch.setattr(T.TokenTree, "_build", lambda *a: built.append(1))
    for _ in range(3):
        tree.edit(50_000, 0, "put in here ")
    assert not built and tree.total == tree.count(tree.text())


def test_clashing_columns_and_null_ids(spark):
    names = "seq at cut put kind".split()
    docs = spark.createDataFrame([(1, "a b c", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    edits = spark.createDataFrame([(1, 1, 0, 1, "zz", "x"), (None, 1, 0, 0, "zz", "x")], "doc_id long, seq int, at int, cut int, put string, text string")
    got = {r.doc_id: (r.n_edits, r.text) for r in T.counted(docs, edits, PATH, P.PATTERN, with_text=True).collect()}
    assert got == {1: (1, "zz b c"), None: (0, "")}


def test_counts_equal_brute_force(spark, documents):
    count = T.encoder(PATH, P.PATTERN)
    docs = documents + [(documents[0][0], "twice"), (None, "no id")]
    edits = [(d, s, s * 7, s % 3, p) for d, _ in documents[:60] for s, p in ((2, "new words"), (1, None), (1, "é"))] + [(-5, 1, 0, 0, "unknown")]
    got = T.counted(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(edits, "doc_id long, seq int, at int, cut int, put string"), PATH, P.PATTERN, with_text=True)
    want = []
    for d, t in docs:
        before = after = t or ""
        mine = sorted((e[1:4] + (e[4] or "",) for e in edits if e[0] == d), key=lambda e: e)
        for _, at, cut, put in mine:
            at = min(at, len(after))
            after = after[:at] + put + after[at + cut :]
        want.append((d, count(before), len(mine), count(after), len(after), after))
    assert sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited, r.n_chars_edited, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 0, 0, "x")], "doc_id long, seq int, at int, cut int, put string")
    assert T.counted(none, edits, PATH, P.PATTERN).count() == 0


def test_text_without_blanks_has_small_leaves():
    count, r = T.encoder(PATH, P.PATTERN), random.Random(8)
    word = lambda: "".join(r.choice("abcdeXYZ") for _ in range(r.randint(1, 8)))
    forms = {
        "json": lambda: f'{{"{word()}":{r.randint(0, 9999)},"{word()}":["{word()}","it\'s"]}},',
        "address": lambda: f"https://{word()}.org/{word()}?{word()}={r.randint(0, 99)}&x='{word()}'/",
        "code": lambda: f"{word()}({word()}_{word()},{r.randint(0, 9)});if(!{word()}){{{word()}++}}",
        "pairs": lambda: f"{word()}{r.randint(0, 99)}:{word()}{r.randint(0, 99)},'x'{r.randint(0, 9)};",
    }
    for name, form in forms.items():
        text = "".join(form() for _ in range(900))[:21_620]
        assert max(map(len, T.leaves(text))) <= 2 * T.LEAF and sum(map(count, T.leaves(text))) == count(text), name
        tree = T.TokenTree(text, count)
        tree.encoded = 0
        tree.edit(10_000, 1, "z")
        assert tree.encoded < 2_000, name
        want = text[:10_000] + "z" + text[10_001:]
        for _ in range(150):
            at, cut, put = r.randrange(len(want) + 1), r.choice([0, 1, 2, 30]), r.choice(["", "'", "s", "'s", "1", " ", '"', "é", "ab", form()])
            want = want[:at] + put + want[at + cut :]
            tree.edit(at, cut, put)
        assert tree.text() == want and tree.total == count(want), name


def test_every_safe_place_is_a_border(monkeypatch):
    monkeypatch.setattr(T, "LEAF", 1)
    count, r = T.encoder(PATH, P.PATTERN), random.Random(2)
    odd = "aZ09'\"`{-/:@[~! \n\t\x0b\x1c\u00a0é日²。٣ǅ_"
    for _ in range(3_000):
        text = "".join(r.choice(odd) for _ in range(r.randint(1, 40))) + r.choice(["", "'s", "'re", "'ll'd", "''ve"])
        assert sum(map(count, T.leaves(text))) == count(text), text
