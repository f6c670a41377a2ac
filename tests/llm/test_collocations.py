import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import collocations as C


def brute(rows, max_n, least, cover, limit):
    """All counts in dictionaries, every longer candidate looked at."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                for k in range(len(w) - n + 1):
                    f.setdefault(lang, Counter())[tuple(w[k : k + n])] += 1
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in chosen.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def prose(seed, n):
    r = random.Random(seed)
    words = "the The new york city a b é ß is is far from it".split(" ") + ["日本", "x\x00y", "😀"]
    marks = [" "] * 30 + ["  ", "\t", ". ", ",", "\n", "\x0b", "; ", "!", "\r\n"]
    return [(r.choice(["en", "en", "en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("max_n, least, cover, limit", [(3, 10, 50, 2000), (3, 4, 80, 7), (5, 2, 50, 2000), (2, 3, 50, 9), (1, 1, 50, 5)])
def test_equals_counting_in_dictionaries(spark, max_n, least, cover, limit):
    rows = prose(max_n, 300) + [("en", None), (None, None), ("de", ""), ("de", " \t.,")] + [("en", "new york city hall")] * 40
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int")
    got = sorted(tuple(r) for r in C.collocations(df, max_n, least, cover, limit).collect())
    assert got == brute(rows, max_n, least, cover, limit)
    assert got or max_n == 1


def test_texts_are_counted_alike_in_chunks_of_any_size(spark):
    rows = prose(9, 60) + [("en", "one two three " * 5_000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    whole = {tuple(r) for r in C.counts(df).collect()}
    data = "".join(t for _, t in rows).encode()
    begin = np.cumsum([0] + [len(t.encode()) for _, t in rows])[:-1]
    names = pa.array(["und" if x is None else x for x, _ in rows]).dictionary_encode()
    number = names.indices.to_numpy().astype(np.int64)

    def added(pieces):
        found = Counter()
        for name, n in pieces:
            found.update(dict(zip(name.to_pylist(), n.tolist(), strict=True)))
        return found

    single = Counter()
    for i, (_, text) in enumerate(rows):
        single += added(C.grams(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64), number[i : i + 1], names.dictionary, 3))
    assert single == added(C.grams(np.frombuffer(data, np.uint8), begin, number, names.dictionary, 3))
    assert whole == {(*k.rsplit("\t", 1), n) for k, n in single.items()}


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 3_000_000_000_011
    df = spark.createDataFrame([("en", "x y", a), ("en", "x", left), ("en", "y", right)], "lang string, phrase string, n long")
    r = C.scored(df).first()
    assert (r.a, r.l, r.r, r.score) == (a, left, right, int(Decimal(10**6) * a * a // (left * right))) == (a, left, right, 10**6 * a * a // (left * right))


def test_no_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_ranks_are_cut_by_steps_without_loss(spark):
    df = spark.range(500).select(F.lit("en").alias("lang"), F.format_string("p%04d q", "id").alias("phrase"), (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("score"))
    got = [(r["rank"], r.phrase) for r in C.best(df, 50).orderBy("rank").collect()]
    want = sorted((-(i % 3), -(i % 5), f"p{i:04d} q") for i in range(500))[:50]
    assert got == [(k, p) for k, (_, _, p) in enumerate(want, 1)]
