import zlib

import numpy as np
import pytest

from spindrift.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x1cb", "x y", "İstanbul É", "<|endoftext|>hi <|startoftext|>", "'s it's I'LL", "é ́x", "12 345", "\t\x0b tab", "日本語 テスト", "ſ K", "a​b", "", "   ", "don't!!", "Ünter—über", "1,000.5%"]


def test_ids_equal_the_tokenizer(documents):
    w = P.word_tokenizer(PATH)
    for text in ODD + [t for _, t in documents if t]:
        assert w.encode(text) == w.whole.encode(text, add_special_tokens=False).ids


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(0)
    for _ in range(300):
        c = np.bincount(rng.integers(1, 101, rng.integers(0, 300)), minlength=101)
        plan, used = P.plan_of(c, 100), np.zeros(101, int)
        for lengths, base, times in plan.rows:
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] += times
        assert (used == c).all()
        assert plan.sequences <= -(-(np.arange(101) * c).sum() * 11 // 900) + 1  # within 11/9 of the optimum


def optimum(items, capacity):
    """Fewest sequences, by trying all."""
    best = len(items)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(items):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + items[i] <= capacity:
                loads[k] += items[i]
                go(i + 1, loads)
                loads[k] -= items[i]
        go(i + 1, loads + [items[i]])

    go(0, [])
    return best


def test_dominance_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(150):
        items = sorted(rng.integers(1, 21, 8).tolist(), reverse=True)
        counts = np.bincount(items, minlength=21)
        plan = P.Plan(20)
        rest = counts.copy()
        P.dominated(rest, plan)
        left = [n for n in range(20, 0, -1) for _ in range(rest[n])]
        assert plan.sequences + optimum(left, 20) == optimum(items, 20)


def test_round_trip(spark, documents):
    rows = documents + [(documents[0][0], documents[0][1]), (9999, "word " * 9000)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, with_ids=True).collect()
    w = P.word_tokenizer(PATH)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*w.encode(t or ""), 1])
    by_doc, by_sequence = {}, {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, lists in want.items():
        for piece, rs in by_doc[d].items():
            assert all(r.ids == ids[r.start : r.start + r.length] for r, ids in zip(rs, lists))
            assert len(rs) == len(lists) and all(r.start == piece * 4096 for r in rs)
    for rs in by_sequence.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 4096


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string, length int"), PATH).count() == 0


def test_clashing_columns_null_ids_and_a_long_text(spark):
    names = "piece start length ids_crc32 salt rank before sequence_id offset".split()
    df = spark.createDataFrame([(1, "one two", *names), (None, None, *names), (None, None, *names), (2, "word " * 30_000, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = P.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got if r.doc_id != 2) == [(0, 1), (0, 1), (1, len(P.word_tokenizer(PATH).encode("one two")) + 1)]
    long = [r for r in got if r.doc_id == 2]
    assert sorted(r.start for r in long) == [4096 * k for k in range(len(long))] and len(long) > 5
