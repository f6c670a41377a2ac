import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from spindrift.llm import tries as T

TURN = "conv_id long, turn int, role string, text string, depth string, key string"


def rebuilt(rows):
    """Every conversation's turns after branching, by plain lists."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in convs.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in children[k])
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], digest(ends[k])) for k, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def chats(seed, n, deep=6):
    r = random.Random(seed)
    texts = ["hello there", "hi", None, "", " tabs\tand\x0blines\n", "a b c d e"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, deep)):
            rows.append((c, t, r.choice(["user", "assistant", None]) if t > 1 else "user", r.choice(texts[: 2 + t])))
    return rows


@pytest.mark.parametrize("limit", [100_000, 40, 3])
def test_equals_brute_force(spark, limit):
    """At every limit: whole tries in one task, first turns split, and all split down to single paths."""
    rows = chats(1, 260) + [(1000 + i, t, "user", f"turn {t}") for i in range(30) for t in range(9)] + [(2000 + i, t, "user", f"turn {t}" if t < 12 else f"own {i}") for i in range(8) for t in range(14)]
    rows += [(None, 0, "user", "of none"), (3000, None, None, None), (3000, 5, "user", "x"), (3000, 5, "user", "x"), (3019, 0, "user", "gone"), (5001, 0, "a", "only")]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], TURN)
    assert found(T.trie(T.branched(df), limit)) == brute(rebuilt(rows))


def test_long_and_empty_conversations(spark):
    convs = {1: [("u", str(i)) for i in range(3_000)], 2: [("u", str(i)) for i in range(2_500)] + [("u", "fork")], 3: [], 4: [], 5: [("u", "0")]}
    rows = [(c, i, r, t) for c, p in convs.items() for i, (r, t) in enumerate(p)]
    listed = T.conversations(T.turns_of(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    none = spark.createDataFrame([(3, []), (4, [])], f"conv_id long, turns {T.TURNS}")
    for limit in (100_000, 500):
        assert found(T.trie(listed.unionByName(none), limit)) == brute(convs)


def test_only_empty_conversations_and_none(spark):
    some = spark.createDataFrame([(3, []), (4, [])], f"conv_id long, turns {T.TURNS}")
    assert found(T.trie(some)) == brute({3: [], 4: []})
    assert T.trie(some.limit(0)).count() == 0
    assert T.trie(T.branched(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(100, 0, "ab", "c"), (200, 0, "a", "bc"), (300, 0, None, "abc"), (400, 0, "abc", None)]
    got = found(T.trie(T.branched(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))))
    assert got == brute(rebuilt(rows))


def test_many_copies_have_one_digest(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 7)
    rows = [(20 * i, 0, "user", "same") for i in range(300)] + [(-20, 0, "user", "same")]
    got = found(T.trie(T.branched(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))))
    assert got == brute(rebuilt(rows))
