"""Prefix tries of conversations: which first turns are shared by whom, and what keeping shared turns once would save.

A turn is known by the SHA-256 of its role and text, so texts stay where they are read. A conversation is the list of its turns'
digests; equal conversations become one path with the number of its members, the smallest id, and the digest of the ids.

Paths begin as one subtrie at the root. In each round the subtries that are larger than `limit` turns are split by their next
turn: the first round deals them by the digest of the first turn. Before that, turns that all paths of a subtrie share are passed at
once, so a round ends at a real fork. Subtries within the limit are dealt to tasks by hash, about `limit` turns to each, and become
pointer dictionary tries inside applyInPandas: a child's number by parent and digest. Nodes are numbered as they are made, parents
first, so walking the numbers backwards is a postorder that needs no recursion. What was split is a few nodes (every subtrie split has
more than `limit` turns); their sums are added up from those of their children, the last round first.

A task holds the tries of about `limit` turns and no more; copies are merged before, and a hot first turn is split by the next. One conversation's
digests are one row (32 bytes a turn). Ids of equal conversations are joined in runs of at most RUN, and the runs of one path, sorted
by Spark, stream through SHA-256.

Cases: null roles and texts are empty; a null turn comes first; rows with the same turn go by role, then by the turn's digest; repeated
rows are turns of their own; rows without a conv_id belong to no conversation and are left out; a conversation may be empty; an
empty table gives no nodes, not even a root; further columns are ignored; a hot conv_id is one row.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, tidy

#: Turns of a subtrie that one task may hold.
LIMIT = 100_000
#: Ids of one run have the same quotient by this.
RUN = 1 << 16
#: Split subtries that may be broadcast.
FEW = 10_000

WORDS = r"[^\x20\x09-\x0D]+"
TURNS = "array<struct<d: binary, words: bigint>>"
NODE = "parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOBODY = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, n, turn) of a table (conv_id, turn, role, text): turns numbered from 1, each as (digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    known = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.struct(digest.alias("d"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).alias("at"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "at.d")
    return known.select("conv_id", F.row_number().over(order).cast("long").alias("n"), "at")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of numbered turns."""
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda x: x["at"]).cast(TURNS).alias("turns"))


def branched(rows: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, turns): every conversation c as a branch of c - c % family, whose first crc32(c) % `shared` turns replace its own."""
    own = conversations(turns_of(rows))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("start"))
    mine = own.select("conv_id", "turns", head.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(first, "base", "left")
    start = F.slice(F.coalesce("start", F.array().cast(TURNS)), F.lit(1), F.col("h"))
    return mine.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).cast(TURNS).alias("turns"))


def _ids(batches):
    """SHA-256 of the joined runs of each path; runs come in order, a path's one behind another."""
    path, digest, done = None, None, []

    def told():
        out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["path", "ends"])
        done.clear()
        return out

    for b in batches:
        for p, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p == path:
                digest.update(b"," + run.encode())
                continue
            if path is not None:
                done.append((path, digest.hexdigest()))
            path, digest = p, hashlib.sha256(run.encode())
        yield told()
    if path is not None:
        done.append((path, digest.hexdigest()))
        yield told()


def paths(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends, turns): distinct conversations, the smallest id, how many, and the digest of their ids."""
    known = materialise(convs.select("conv_id", F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""), 256)).alias("path"), "turns"), "trie-conversations")
    many = known.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    runs = known.groupBy("path", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = runs.repartition("path").sortWithinPartitions("path", "run").select("path", "ids").mapInArrow(tidy(_ids), "path binary, ends string")
    return many.join(known.select("conv_id", "turns"), "conv_id").join(ends, "path").select("conv_id", "n", "ends", "turns")


def _nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """The tries of some subtries: parallel lists of nodes, and of each the numbers of its children by digest."""
    parent, depth, conv, many, words, ends, above, over = [], [], [], [], [], [], [], []
    children: list[dict[bytes, int]] = []

    def made(up: int, deep: int, n_words: int, key, conv_above) -> int:
        parent.append(up), depth.append(deep), conv.append(None), many.append(0), words.append(n_words), ends.append(NOBODY), above.append(key), over.append(conv_above)
        children.append({})
        return len(parent) - 1

    tops: dict[bytes, int] = {}
    for key, up, up_conv, deep, c, n, end, turns in zip(frame["key"], frame["parent"], frame["parent_conv_id"], frame["depth"], frame["conv_id"], frame["n"], frame["ends"], frame["turns"], strict=True):
        at = tops.get(key)
        if at is None:
            at = tops[key] = made(-1, deep, turns[deep - 1]["words"], up, up_conv)
        i = deep
        while True:
            conv[at] = c if conv[at] is None else min(conv[at], c)
            many[at] += n
            if i == len(turns):
                break
            turn = turns[i]
            below = children[at].get(turn["d"])
            if below is None:
                below = children[at][turn["d"]] = made(at, i + 1, turn["words"], None, None)
            at, i = below, i + 1
        ends[at] = end
    leaves = [0 if x else 1 for x in children]
    saved = [(n - 1) * w for n, w in zip(many, words, strict=True)]
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
            over[i] = conv[parent[i]]
    return pd.DataFrame({"parent": above, "conv_id": conv, "depth": depth, "parent_conv_id": pd.array(over, "Int64"), "n_convs": many, "n_children": [len(x) for x in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def _next(key: Column, turn: Column) -> Column:
    return F.unhex(F.sha2(F.concat(key, turn["d"]), 256))


def _common(a: Column, b: Column) -> Column:
    """How many turns two lists begin with alike."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x["d"] == y["d"], F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _forks(big: DataFrame) -> DataFrame:
    """(key, conv_id, n_convs, depth, until, chain): each large subtrie's members, where it begins and where it forks."""
    # what the first and the last path begin with alike, all others do
    seen = big.groupBy("key", "parent", "parent_conv_id", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("turns").alias("low"), F.max("turns").alias("high"))
    until = F.greatest("depth", _common(F.col("low"), F.col("high")))
    return seen.select("key", "parent", "parent_conv_id", "depth", "conv_id", "n_convs", until.alias("until"), F.slice("low", F.lit(1), until).alias("chain"))


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turns):

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node is named by its smallest member and
    its depth; saved_tokens is summed over its subtree, (members - 1) times the words of each node's last turn.
    """
    found = paths(convs)
    root = F.unhex(F.sha2(F.lit(""), 256))
    none = F.lit(None)
    big = materialise(found.select(root.alias("key"), none.cast("binary").alias("parent"), none.cast("long").alias("parent_conv_id"), F.lit(0).alias("depth"), "conv_id", "n", "ends", "turns"), "trie-paths")
    rounds = []
    while not big.isEmpty():
        forks = materialise(_forks(big), "trie-forks")
        few = forks.count() <= FEW  # each stands for more than `limit` turns; the first round has the root alone
        ahead = forks.select("key", "until", F.col("conv_id").alias("fork_conv_id"))
        on = big.join(F.broadcast(ahead) if few else ahead, "key").withColumn("depth", F.col("until"))
        here = on.where(F.size("turns") == F.col("depth")).groupBy("key").agg(F.max("ends").alias("ends"))
        turn = F.get("turns", F.col("depth"))
        deeper = on.where(F.size("turns") > F.col("depth")).select(_next(F.col("key"), turn).alias("key"), F.col("key").alias("parent"), F.col("fork_conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), "conv_id", "n", "ends", "turns")
        deeper = materialise(deeper, "trie-deeper")
        left = F.size("turns") - F.col("depth") + 1
        sizes = deeper.groupBy("key").agg(F.sum(left).alias("left"))
        tasks = max(4 * partitions(convs.sparkSession), (sizes.agg(F.sum("left")).first()[0] or 0) // limit + 1)
        sized = deeper.join(sizes, "key")
        small = sized.where(F.col("left") <= limit).drop("left")
        built = small.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")).applyInPandas(_nodes, NODE)
        nodes = materialise(built, "trie-nodes")
        rounds.append((forks, here, nodes))
        big = materialise(sized.where(F.col("left") > limit).drop("left"), "trie-paths")
    shown = None
    tops = None
    for forks, here, nodes in reversed(rounds):
        below = nodes.where("parent is not null").select("parent", "n_leaves", "saved_tokens")
        below = below if tops is None else below.union(tops)
        sums = below.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        whole = forks.join(sums, "key", "left").join(here, "key", "left")
        # the turns passed at once are nodes with one child each; the root has no turn of its own
        steps = F.sequence(F.greatest(F.col("depth"), F.lit(0)), F.col("until"))
        step = whole.select("*", F.explode(steps).alias("at"))
        later = F.aggregate(F.slice("chain", F.greatest(F.col("at"), F.lit(1)), F.size("chain")), F.lit(0).cast("long"), lambda n, t: n + t["words"])
        last = F.col("at") == F.col("until")
        made = step.select(
            F.when(F.col("at") == F.col("depth"), F.col("parent")).alias("parent"),
            "conv_id",
            F.col("at").cast("long").alias("depth"),
            F.when(F.col("at") == F.col("depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * later).cast("long").alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(NOBODY))).otherwise(NOBODY).alias("ends_sha256"),
        )
        made = materialise(made, "trie-split")
        tops = made.where("parent is not null").select("parent", "n_leaves", "saved_tokens")
        both = nodes.unionByName(made)
        shown = both if shown is None else shown.unionByName(both)
    if shown is None:
        shown = convs.sparkSession.createDataFrame([], NODE)
    return shown.drop("parent")
