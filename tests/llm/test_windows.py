import random

import numpy as np

from spindrift.llm import windows as W


def test_compact_windows_equal_brute_force():
    r = random.Random(0)
    for _ in range(300):
        n, width, rows = r.randint(0, 60), r.randint(1, 12), r.randint(1, 3)
        h = np.array([r.randrange(12) << 40 for _ in range(n)], np.uint64)
        row = np.sort(np.array([r.randrange(rows) for _ in range(n)], np.int64))
        l, c, e = W.compact_windows(h, row, width)
        want = set()
        for i in range(n):
            for j in range(i + width - 1, n):
                if row[i] != row[j]:
                    break
                least = h[i : j + 1].min()
                a, b = i, j
                while a > 0 and row[a - 1] == row[i] and h[a - 1] >= least:
                    a -= 1
                while b < n - 1 and row[b + 1] == row[i] and h[b + 1] >= least:
                    b += 1
                want.add((a, int(least), b))
        assert {(a, int(h[k]), b) for a, k, b in zip(l.tolist(), c.tolist(), e.tolist())} == want
        keep = W.thinned(l, c, h[c], width) if width >= 4 else np.arange(len(c))
        kept = {(l[k], h[c[k]]): set() for k in keep}
        for k in keep:
            kept[l[k], h[c[k]]].add(int(c[k]))
        for i in range(n):
            for j in range(i + width - 1, n):
                if row[i] != row[j]:
                    break
                least = h[i : j + 1].min()
                assert any(i <= x <= j for (a, v), places in kept.items() if v == least for x in places)


def prose(r, n):
    return [("".join(r.choices("the an ou er st ing re ha ti é ß".split(), k=r.randint(2, 4)))) for _ in range(n)]


def corpus(n=90):
    """Passages that come back exact, with single words changed, with words put into their middle, or with their halves swapped."""
    r = random.Random(7)
    shared = [prose(r, k) for k in (50, 52, 60, 64, 80, 80, 120, 200)]
    out = []
    for i in range(n):
        w = prose(r, r.randint(0, 150))
        if i % 3 < 2:
            passage = list(r.choice(shared))
            half = len(passage) // 2
            kind = r.randrange(5)
            if kind == 1:
                for _ in range(r.randint(1, 3)):
                    k = r.randrange(len(passage))
                    passage[k : k + 1] = r.choice([[], prose(r, 1), prose(r, 2)])
            elif kind == 2:
                passage[half:half] = prose(r, r.randint(1, 10))
            elif kind == 3:
                passage = passage[half:] + passage[:half]
            at = r.randint(0, len(w))
            w[at:at] = passage
        out.append((i * 2 + 1, " ".join(w) if w else r.choice([None, ""])))
    out.append((500, out[4][1]))
    out.append((501, "again and again " * 300))
    return out


def runs_of(flags):
    starts = [i for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1])]
    ends = [i for i, f in enumerate(flags) if f and (i == len(flags) - 1 or not flags[i + 1])]
    return starts, ends


def alike(a, b, width=46, similarity=0.8):
    """The words of the token list `a` in passages that some passage of `b` is like: all runs of shared tokens as ends, by sets."""
    sa, sb = set(a), set(b)
    covered = set()
    if len(sa & sb) < 37:
        return covered
    (s1, e1), (s2, e2) = runs_of([t in sb for t in a]), runs_of([t in sa for t in b])
    others = [(q := b[k : l + 1], set(q)) for k in s2 for l in e2 if l >= k]
    need = -(-2 * width * similarity // (1 + similarity))
    for i in s1:
        for j in e1:
            part = a[i : j + 1]
            p = set(part)
            for q, own in others if j >= i else ():
                both = p & own
                if len(both) >= similarity * len(p | own) and sum(t in both for t in part) >= need <= sum(t in both for t in q):
                    covered |= set(range(i, j + 5))
                    break
    return covered


def brute(rows):
    """For each document {other document: its words in passages that the other has a near duplicate of}, and in equal passages of 50 words."""
    tokens = {doc: (w := (t or "").lower().split(), [tuple(w[i : i + 5]) for i in range(len(w) - 4)]) for doc, t in rows}
    near = {a: {b: c for b in tokens if b != a and (c := alike(tokens[a][1], tokens[b][1]))} for a in tokens}
    fifty = {doc: [tuple(w[i : i + 50]) for i in range(len(w) - 49)] for doc, (w, _) in tokens.items()}
    same = {a: {b: {k for i, p in enumerate(fifty[a]) if p in have for k in range(i, i + 50)} for b in near[a] for have in [set(fifty[b])]} for a in near}
    return near, same


def test_equals_brute_force(spark):
    rows = corpus()
    near, same = brute(rows)
    got = {r.doc_id: r for r in W.passages(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int")).collect()}
    want, found = 0, 0
    for doc, text in rows:
        words = (text or "").split()
        covered = {k for s in got[doc].spans for k in range(s.start, s.end)}
        later = {k for s in got[doc].later for k in range(s.start, s.end)}
        assert covered <= set().union(*near[doc].values())  # nothing that isn't repeated
        assert later <= set().union(*(c for b, c in near[doc].items() if b < doc)) & covered
        assert covered >= set().union(*same[doc].values())  # all that is repeated as it is
        assert later >= set().union(*(c for b, c in same[doc].items() if b < doc))
        want += len(set().union(*near[doc].values()))
        found += len(covered)
        assert got[doc].kept.split() == [w for k, w in enumerate(words) if k not in later]
        assert got[doc].class_id == doc or got[doc].class_id in near[doc] and got[doc].class_id < doc
        assert got[doc].n_words == len(words)
    print("recall", found / want)
    assert want > 3000 and found > 0.95 * want


def test_recall_at_the_least_similarity(spark):
    """Pairs of documents that share one passage each, at similarities just above 0.8, in each of the ways that tests of single places miss."""
    r = random.Random(21)
    rows, want = [], {}
    for i in range(600):
        kind, size = i % 4, (50, 60, 80, 100)[i // 4 % 4]
        passage, other = prose(r, size), None
        for more in range(12, 0, -1):
            other = list(passage)
            half = size // 2
            if kind == 0:  # words put into the middle
                other[half:half] = prose(r, more)
            elif kind == 1:  # halves swapped, and words left out between them
                other = passage[half + more // 2 :] + passage[: half - more // 2]
            elif kind == 2:  # words changed anywhere
                for k in r.sample(range(size), min(more, 3)):
                    other[k] = prose(r, 1)[0] + "x"
            else:  # the end is left out
                other = passage[: max(50, size - more)] + prose(r, more)
            a, b = ([tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in (passage, other))
            both = len(set(a) & set(b))
            if both >= 0.8 * (len(set(a) | set(b))) and len(other) >= 50:
                break
        else:
            continue
        for doc, text in ((2 * i, passage), (2 * i + 1, other)):
            head, tail = ([f"{doc}{side}{k}" for k in range(r.randint(5, 60))] for side in "ab")
            rows.append((doc, " ".join(head + text + tail)))
            want[doc] = {k + len(head) for k in alike([tuple(text[k : k + 5]) for k in range(len(text) - 4)], b if doc % 2 == 0 else a)}
    assert len(rows) > 800
    got = W.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    part = [len({k for s in x.spans for k in range(s.start, s.end)} & want[x.doc_id]) / len(want[x.doc_id]) for x in got if want[x.doc_id]]
    print("recall", sum(part) / len(part), sum(p > 0.5 for p in part) / len(part))
    assert sum(part) / len(part) >= 0.9


def test_large_buckets_find_what_small_ones_find(spark, monkeypatch):
    """A passage in very many documents, some of which share more around it, and near copies of one text."""
    r = random.Random(4)
    hot, base = prose(r, 60), prose(r, 140)
    rows = []
    for i in range(420):
        w = prose(r, 30)
        if i % 7 == 0:
            w = [f"more{i // 14}x{k}" for k in range(30)]  # two documents each share this
        copy = [x if r.random() > 0.02 else x + "z" for x in base]
        rows.append((i, " ".join(w + hot + prose(r, 20) if i % 2 else prose(r, 5) + copy + prose(r, 5))))
        if i % 7 == 0 and i % 2:
            rows.append((1000 + i, " ".join(w + hot + prose(r, 20))))
    column = [t for _, t in rows]
    width = 46
    import pyarrow as pa

    h = np.concatenate([h for h, _ in W.keys(pa.array(column), width)])
    values, many = np.unique(h, return_counts=True)
    held = [(h, i, i, at, left, size, words) for h, i, at, left, size, words in W.contexts(pa.array(column), values[many > 1], width)]
    table = pa.Table.from_batches(list(W.collected(held))).sort_by("h").combine_chunks()

    def found():
        out = {}
        for b in W.compared_batches(table, width, 0.8):
            for row, start, end, first in zip(*(c.to_pylist() for c in b.columns)):
                for k in range(start, end):
                    out[row, k] = min(out.get((row, k), 10**9), first)
        return out

    large = found()
    monkeypatch.setattr(W, "LISTED", 10**6)
    small = found()
    assert len(small) > 10_000 and set(small) - set(large) == set() == set(large) - set(small)
    # a place that a smaller document has is known to be one that a smaller document has
    assert [k for k in small if (small[k] < k[0]) != (large[k] < k[0])] == []


def test_clashing_columns(spark):
    names = "row spans hs hot h left segment least docs at rest first n".split()
    text = " ".join(prose(random.Random(2), 80))
    df = spark.createDataFrame([(1, text, *names), (2, "more " + text, *names), (3, None, *names)], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    got = W.deduplicated(df)
    assert got.columns == df.columns and got.schema == df.schema
    assert sorted(map(tuple, got.collect())) == [(1, text, *names), (2, "more ", *names)] + [(3, None, *names)]
    assert {r.class_id for r in W.passages(df).collect()} == {1, 3}


def test_equal_passages_of_a_repeating_line_that_starts_at_another_phase(spark):
    r = random.Random(3)
    rows, want = [], {}
    for i, (period, more) in enumerate([(20, 10), (20, 15), (12, 6), (8, 4)] * 15):
        line = [f"w{i}x{k}" for k in range(period)] * 20
        passage = line[more : more + 50]
        for doc, before in ((2 * i, line[:more]), (2 * i + 1, [])):
            head, tail = ([f"{doc}{side}{k}" for k in range(r.randint(20, 80))] for side in "ab")
            rows.append((doc, " ".join(head + before + passage + tail)))
            start = len(head) + len(before)
            want[doc] = set(range(start, start + 50))
    found = W.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in found}
    assert [doc for doc in want if not want[doc] <= covered[doc]] == []
    assert all({k for s in x.later for k in range(s.start, s.end)} >= want[x.doc_id] for x in found if x.doc_id % 2)


def test_edge_cases(spark):
    assert W.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(prose(random.Random(1), 30_000))
    rows = [(None, long), (4, long), (4, long + " more"), (5, None), (6, "")]
    got = sorted(((r.doc_id or 0, len(r.later), len(r.spans), r.kept == "") for r in W.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 1, 1, True), (4, 0, 1, False), (4, 0, 1, False), (5, 0, 0, True), (6, 0, 0, True)]


def test_pairs_of_a_bucket_of_many_tokens_are_compared_as_many_at_once(monkeypatch):
    """The work of a pair doesn't grow with the tokens of its bucket, and both sides' shared tokens are those of one side at a time."""
    rng = np.random.default_rng(5)
    size = 2 * W.REACH + W.SHINGLE
    texts = rng.integers(0, 60_000, (100, size)).astype(np.uint16)
    words = np.concatenate([texts, np.where(rng.random(texts.shape) < 0.02, 7, texts)]).astype(np.uint16)
    m = len(words)
    one = np.ones(m, np.int64)
    bucket = W.Bucket(0 * one, W.REACH * one, size * one, words.ravel(), one, np.arange(m), 46, 0.8)
    monkeypatch.setattr(W, "TABLE", 100_000)
    assert bucket.tokens[0] > 10_000
    x, y = np.repeat(np.arange(100, 110), 100), np.tile(np.arange(100), 10)
    for a, b in ((x, y), (y, x)):
        mine, theirs = bucket._shared(a, b)
        room = int(bucket.tokens[0]) + 1
        assert (mine == bucket._flags(a, b, room)).all() and (theirs == bucket._flags(b, a, room)).all()
    calls = []
    plain = W.Bucket._compare
    monkeypatch.setattr(W.Bucket, "_compare", lambda self, *args: calls.append(len(args[0])) or plain(self, *args))
    bucket.compare(x, y)
    assert calls == [1000]
    assert (bucket.first[100:110] < W.A.LAST).any(axis=1).sum() >= 8


def family(rng, m, changed, kept=0):
    """Nodes of a bucket: copies of one text with random words changed, a block of `kept` words around the anchor left alone and all others new."""
    size = 2 * W.REACH + W.SHINGLE
    words = np.repeat(rng.integers(0, 60_000, (1, size)), m, axis=0)
    other = rng.random(words.shape) < changed
    other[:, W.REACH : W.REACH + W.SHINGLE] = False
    if kept:
        other[:] = True
        other[:, W.REACH - kept // 2 : W.REACH - kept // 2 + kept] = False
    words[other] = rng.integers(0, 60_000, int(other.sum()))
    one = np.ones(m, np.int64)
    return W.Bucket(0 * one, W.REACH * one, size * one, words.astype(np.uint16).ravel(), one, np.arange(m), 46, 0.8)


def test_pairs_of_a_large_bucket_grow_with_its_nodes_not_with_their_square(monkeypatch):
    """Nodes that have no partner in some tokens, or share less than any two that are alike, don't meet all others one by one."""
    pairs = []
    plain = W.Bucket.compare
    monkeypatch.setattr(W.Bucket, "compare", lambda self, x, y: pairs.append(len(x)) or plain(self, x, y))
    for m, changed, kept in ((500, 0.04, 0), (500, 0.06, 0), (500, 0, 43), (300, 0.02, 0)):
        b = family(np.random.default_rng(8), m, changed, kept)
        pairs.clear()
        b.run()
        met = sum(pairs)
        whole = family(np.random.default_rng(8), m, changed, kept)
        with monkeypatch.context() as listed:
            listed.setattr(W, "LISTED", 10**6)
            whole.run()
        assert ((b.first < W.A.LAST) == (whole.first < W.A.LAST)).all()
        assert ((b.first < b.least[:, None]) == (whole.first < b.least[:, None])).all()
        assert (b.first < W.A.LAST).any() == (kept == 0)
        assert met < 40 * m


def test_nodes_that_repeat_tokens_find_each_other_in_a_large_bucket(monkeypatch):
    """Lines that come again at other phases and in another order, with words changed."""
    rng = np.random.default_rng(11)
    m, size = 300, 2 * W.REACH + W.SHINGLE
    lines = rng.integers(0, 60_000, (6, 17))
    words = np.empty((m, size), np.int64)
    for row in words:
        row[:] = np.concatenate([lines[k] for k in rng.integers(0, 6, 12)])[:size]
        row[W.REACH - 6 : W.REACH + 11] = lines[0]
    other = rng.random(words.shape) < 0.02
    other[:, W.REACH - 6 : W.REACH + 11] = False
    words[other] = rng.integers(0, 60_000, int(other.sum()))
    one, found = np.ones(m, np.int64), []
    for listed in (W.LISTED, 10**6):
        monkeypatch.setattr(W, "LISTED", listed)
        b = W.Bucket(0 * one, W.REACH * one, size * one, words.astype(np.uint16).ravel(), one, np.arange(m), 46, 0.8)
        b.run()
        found.append((b.first < W.A.LAST, b.first < b.least[:, None]))
    assert all((x == y).all() for x, y in zip(*found))
    assert found[0][0].any(axis=1).sum() > 50
