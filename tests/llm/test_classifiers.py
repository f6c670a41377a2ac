import random

import numpy as np
import pytest

from spindrift.llm import quality as Q
from spindrift.llm import toxicity as T


@pytest.fixture(scope="module")
def labelled():
    """(doc_id, text, toxic, quality): toxic texts hold one of three words somewhere, poor ones are shouted."""
    r = random.Random(3)
    out = []
    for i in range(600):
        words = ["".join(r.choices(["an", "the", "or", "en", "is", "ti", "ou", "ß"], k=r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        toxic, quality = int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            words[r.randrange(len(words))] = r.choice(["vilefool", "grotbag", "scumling"])
        text = " ".join(words)
        out.append((i, text if quality else text.upper().replace(" ", "!! "), toxic, quality))
    return out


@pytest.mark.parametrize("module,label,least", [(T, "toxic", 0.95), (Q, "quality", 0.97)])
def test_held_out_accuracy(spark, labelled, module, label, least):
    rows = spark.createDataFrame(labelled, "doc_id long, text string, toxic int, quality int")
    model = module.train(rows.drop("toxic", "quality"), rows.select("doc_id", rows[label].alias("label")), "doc_id % 3 <> 1")
    got = {r.doc_id: r.score for r in module.score(rows, model).collect()}
    truth = {d: (t if label == "toxic" else q) for d, _, t, q in labelled}
    assert np.mean([(got[d] >= 0.5) == truth[d] for d in truth if d % 3 == 1]) >= least
    assert all(0 <= s <= 1 for s in got.values())


@pytest.mark.parametrize("module", [T, Q])
def test_edge_cases(spark, module):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "a b", 5.0), (4, "xy " * 100_000, None), (4, "xy " * 100_000, None)], "doc_id long, text string, score double")
    none = module.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {round(r.score, 6) for r in module.score(docs, none).collect()} == {0.0}
    model = module.train(docs, spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, label int"))
    got = [(r.doc_id, r.score) for r in module.score(docs, model).collect()]
    assert len(got) == 5 and len({s for d, s in got if d == 4}) == 1 and len({s for d, s in got if d in (1, 2)}) == 1
    assert module.score(docs.limit(0), model).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, many, y = rng.normal(size=(9, Q.WIDTH)), np.array([2, 3, 4]), np.array([1, 0, 1.0])
    size = {"W": (Q.WIDTH, Q.HIDDEN), "b": (Q.HIDDEN,), "V": (Q.HIDDEN, Q.GATE), "U": (Q.HIDDEN, Q.GATE), "w": (Q.GATE,), "c": (Q.HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 0.2, s) for k, s in size.items()}

    def loss(w):
        p = Q.forward(w, x, many)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = Q.gradients(w, x, many, y, np.ones(3))
    for k in w:
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = ({a: b.copy() for a, b in w.items()} for _ in range(2))
        up[k][i] += 1e-6
        down[k][i] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - g[k][i]) < 1e-6


def plain_features(text):
    """Distinct buckets of n-grams, one by one, in whole numbers."""
    m = 2**64
    points = [32, *map(ord, text.lower()), 32]
    words = [int(T.mix(np.array([(p * 0x9E3779B97F4A7C15 + 1) % m], np.uint64))[0]) for p in points]
    found = set()
    for n in T.GRAMS:
        for i in range(len(points) - n + 1):
            h = words[i]
            for k in range(1, n):
                h = (h * 0xD6E8FEB86659FD93 + words[i + k]) % m
            h ^= h >> 32
            h ^= n * 0x9E3779B1
            found.add((h * 0xBF58476D1CE4E5B9 % m) >> 44)
    return found


def test_toxicity_equals_a_plain_version():
    r = random.Random(5)
    rows = [(" ".join(r.choices(["bad", "worse", "good", "fine", "Ärger", "x"], weights=(8, 4, 1, 1, 1, 1) if i % 3 == 0 else (1, 1, 6, 6, 1, 1), k=r.randint(1, 8))), int(i % 3 == 0)) for i in range(60)]
    rows += [("", 0)]
    sets = [plain_features(t) for t, _ in rows]
    assert all(set(T.features(t).tolist()) == s for (t, _), s in zip(rows, sets))
    many = [sum(y == k for _, y in rows) for k in (0, 1)]
    count = {}
    for s, (_, y) in zip(sets, rows):
        for f in s:
            count.setdefault(f, [0, 0])[y] += 1
    ratio = {f: np.log((c[1] + 1) / (many[1] + 2)) - np.log((c[0] + 1) / (many[0] + 2)) for f, c in count.items()}
    ratio = {f: x for f, x in ratio.items() if sum(count[f]) >= 3 and abs(x) >= T.FLAT}
    weight, square, bias = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-3), 0.0
    rng = np.random.default_rng(0)
    for _ in range(6):
        for i in rng.permutation(len(rows)):
            y, own = rows[i][1], [f for f in sets[i] if f in ratio]
            p = 1 / (1 + np.exp(-(bias + sum(weight[f] * ratio[f] for f in own))))
            g = (p - y) * 0.5 / many[y] * len(rows)
            for f in own:
                step = g * ratio[f] + 1e-6 * weight[f]
                square[f] += step * step
                weight[f] -= 0.05 * step / np.sqrt(square[f])
            bias -= 0.005 * g
    model = T.fit(rows, 0.3)
    for text in [t for t, _ in rows[:20]] + ["", "bad good unseen"]:
        plain = bias + sum(weight[f] * ratio[f] for f in plain_features(text) if f in ratio)
        assert abs(model.score(text) - 1 / (1 + np.exp(-plain))) < 1e-3


def test_attention_equals_a_plain_version():
    rng = np.random.default_rng(2)
    size = {"W": (Q.WIDTH, Q.HIDDEN), "b": (Q.HIDDEN,), "V": (Q.HIDDEN, Q.GATE), "U": (Q.HIDDEN, Q.GATE), "w": (Q.GATE,), "c": (Q.HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 0.3, s) for k, s in size.items()}
    texts = ["", "short one", "A longer text, in SEVERAL passages! " * 60, "x" * 1700]
    got = Q.Model(w).score(texts)
    encoded, many = Q.encode(texts)
    at = 0
    for text, n, score in zip(texts, many, got):
        assert n == max(1, -(-len(text) // Q.PASSAGE))
        hidden, gate = [], []
        for e in encoded[at : at + n]:
            h = [np.tanh(sum(e[i] * w["W"][i, j] for i in range(Q.WIDTH)) + w["b"][j]) for j in range(Q.HIDDEN)]
            t = [np.tanh(sum(h[i] * w["V"][i, j] for i in range(Q.HIDDEN))) for j in range(Q.GATE)]
            s = [1 / (1 + np.exp(-sum(h[i] * w["U"][i, j] for i in range(Q.HIDDEN)))) for j in range(Q.GATE)]
            hidden.append(h)
            gate.append(np.exp(sum(w["w"][j] * t[j] * s[j] for j in range(Q.GATE))))
        z = [sum(g / sum(gate) * h[j] for g, h in zip(gate, hidden)) for j in range(Q.HIDDEN)]
        assert abs(score - 1 / (1 + np.exp(-(sum(w["c"][j] * z[j] for j in range(Q.HIDDEN)) + w["d"][0])))) < 1e-4
        at += n


def test_rejected_carries_columns_of_any_name(spark, labelled):
    names = "score found label _score".split()
    rows = spark.createDataFrame([(d, t, *names) for d, t, *_ in labelled[:50]] + [(None, None, *names)], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    model = T.fit([(t, y) for _, t, y, _ in labelled], 0.3)
    kept, gone = T.rejected(rows, model, keep=True), T.rejected(rows, model)
    assert kept.schema == rows.schema == gone.schema and kept.count() + gone.count() == 51
    assert {r.doc_id for r in gone.collect()} == {d for d, t, *_ in labelled[:50] if model.score(t) >= T.THRESHOLD}
