"""Benchmark decontamination by a set of the test's n-grams that travels with the tasks, with DataFrame functions only.

A window is `n` consecutive words of a benchmark item (all of an item's words if it has fewer). Documents are searched in
one pass over their words:

- every window of n words holds a run of `n // 2` words that starts at a multiple of n - n // 2 + 1 in the document. Only those runs
  are hashed and looked up among the hashes of all such runs of the items. Few documents pass;
- the documents that pass look up all their windows as strings of words, so every hit is one by its words.

The sets go with each stage's task binary, which Spark broadcasts, after a check of their bytes (`LIMIT`); a larger benchmark is
joined instead: the sampled runs by their hash, then the windows of the documents that had one. Items with fewer than n
words are found by their first word in the first step and their own length in the second. Removal needs no join at
all within the limit; naming the items joins the windows that were hit with the broadcast items.

Words: A-Z in lower case, then runs of other than ASCII separators, in both steps and on both sides alike.

Cases: null has no words; items without words have no window; equal items and equal documents each count for themselves;
item_id may be of any type; empty tables give no hits; further columns of the documents, of any name, are carried along by
`decontaminated`; `hits` replaces n_words, hit and items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, restored

N = 10
#: Bytes of the benchmark's windows up to which they travel with the tasks.
LIMIT = 16_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACES = "array<struct<at:int,len:int,win:string>>"


def words_of(text: Column) -> Column:
    """The words of a text that is in lower case already."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, item, times, words, win, len): the windows of every item; `item` tells items of one id apart, `times` counts equal ones.

    `win` is a window as one string: no word holds a blank.
    """
    own = items.select("item_id", words_of(lowered(F.col("text"))).alias("w")).where(F.size("w") > 0).groupBy("item_id", "w").agg(F.count("*").cast("int").alias("times"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    windows = own.select("item_id", F.xxhash64("w").alias("item"), "times", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, n)))).alias("words"))
    return windows.withColumn("win", F.array_join("words", " ")).withColumn("len", F.size("words"))


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def _among(column: Column, values: list) -> Column:
    return column.isin(values) if values else F.lit(False)


def _searched(docs: DataFrame, windows: DataFrame, n: int, limit: int) -> tuple[DataFrame, bool]:
    """`docs` (of carried()) with `s`, a struct of `n_words` and `hit`, array of (at, len, win): the windows that occur; and
    whether those are sure. Beyond the limit `hit` has all windows of the documents that may have one.
    """
    run, step = max(1, n // 2), n - max(1, n // 2) + 1
    lengths, size = [], 0
    for r in windows.groupBy("len").agg(F.sum(F.length("win") + 16).alias("bytes")).collect():  # at most n rows
        lengths.append(r["len"])
        size += r["bytes"]
    runs = windows.where(F.col("len") == n).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(n - run + 1)), lambda i: _hash(F.slice("words", i, run)))).alias("h")).distinct()
    firsts = windows.where(F.col("len") < n).select(F.col("words")[0].alias("first")).distinct()
    starts_of = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - run + 1, F.lit(step)), lambda i: _hash(F.slice(w, i, run)))).otherwise(F.array().cast("array<bigint>"))
    words = words_of(lowered(F.col("text")))
    sure = size <= limit
    if sure:
        hashes = [r[0] for r in runs.collect()]
        known = windows.select("len", "win").distinct().collect()
        strings, first = [r["win"] for r in known], sorted({r["win"].split(" ")[0] for r in known if r["len"] < n})

        def passes(w: Column) -> Column:
            some = F.exists(starts_of(w), lambda h: _among(h, hashes))
            return some | F.exists(w, lambda x: _among(x, first)) if first else some

        base = docs
    else:
        base = docs.withColumn("k", F.xxhash64("doc_id", "text")).withColumn("l", F.xxhash64("text", "doc_id"))
        found = base.select("k", "l", F.explode(_bound(words, starts_of)).alias("h")).join(runs, "h", "left_semi").select("k", "l")
        if any(size < n for size in lengths):
            found = found.union(base.select("k", "l", F.explode(F.array_distinct(words)).alias("first")).join(firsts, "first", "left_semi").select("k", "l"))
        base = base.join(found.distinct().withColumn("p", F.lit(True)), ["k", "l"], "left").drop("k", "l")
        passes = lambda w: F.coalesce("p", F.lit(False))

    def places(w: Column, size: int) -> Column:
        at = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
        every = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), F.array_join(F.slice(w, i, size), " ").alias("win")))
        return F.filter(every, lambda x: _among(x["win"], strings)) if sure else every

    def hit(w: Column) -> Column:
        none = F.array().cast("array<string>")
        if not lengths:
            return F.array().cast(_PLACES)
        return _bound(F.when(passes(w), w).otherwise(none), lambda v: F.array_sort(F.concat(*(places(v, size) for size in lengths))))

    searched = _bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hit(w).alias("hit")))
    return base.select("doc_id", "text", "rest", searched.alias("s")), sure


def _bound(value: Column, body) -> Column:
    """`body` of a value that is made once, however often the body names it and wherever the optimizer moves it."""
    return F.transform(F.array(value), body)[0]


def hits(docs: DataFrame, items: DataFrame, n: int = N, limit: int = LIMIT) -> DataFrame:
    """`docs` with `n_words`, `hit` (array of start and length of occurring windows, in words) and `items` (the ids of items that occur)."""
    names = ("n_words", "hit", "items")
    windows = item_windows(items, n)
    found, sure = _searched(carried(docs), windows, n, limit)
    # one row for each hit; a document without any is one row of its own key, so that none is dealt to one place
    numbered = found.withColumn("id", F.monotonically_increasing_id())
    spread = numbered.select("doc_id", "text", "rest", "s.n_words", "id", F.explode_outer("s.hit").alias("x"))
    spread = spread.withColumn("win", F.coalesce("x.win", F.concat(F.lit(" "), F.col("id").cast("string"))))
    named = windows.select("win", F.struct("item_id", "item", "times").alias("i"))
    joined = spread.join(F.broadcast(named) if sure else named, "win", "left")
    own = [F.first(c).alias(c) for c in ("doc_id", "text", "rest", "n_words")]
    place = F.when(F.col("i").isNotNull(), F.struct(F.col("x.at").alias("at"), F.col("x.len").alias("len")))
    rows = joined.groupBy("id").agg(*own, F.array_sort(F.collect_set(place)).alias("hit"), F.collect_set("i").alias("is"))
    ids = F.flatten(F.transform("is", lambda i: F.array_repeat(i["item_id"], i["times"])))
    kept = [c for c in docs.columns if c not in names]
    return restored(rows, docs.select(*kept), *names[:2], ids.alias("items"))


def n_hit(hit: Column) -> Column:
    """The number of words inside the windows: the size of the union of sorted intervals."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["at"] + x["len"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(F.least(s["end"], end), x["at"])).alias("n"))

    return F.aggregate(hit, start, step, lambda s: s["n"])


def decontaminated(docs: DataFrame, items: DataFrame, n: int = N, remove: str = "document", limit: int = LIMIT) -> DataFrame:
    """`docs` without the documents that hold a window (`remove="document"`), or without the words inside windows (`"span"`).

    Removing spans cuts the text from the first to the last character of each hit run, separators around it included on
    the left; the rest stays as it is.
    """
    windows = item_windows(items, n)
    found, sure = _searched(carried(docs), windows, n, limit)
    if not sure:
        found = hits(carried(docs), items, n, limit).withColumn("s", F.struct("hit"))
    if remove == "document":
        return restored(found.where(F.size("s.hit") == 0), docs)
    clean, hit = F.size("s.hit") == 0, F.col("s.hit")
    # words and the separators before them, in order; those of hit words go
    pieces = F.expr(r"regexp_extract_all(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")
    tail = F.regexp_extract(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    gone = F.array_distinct(F.flatten(F.transform(hit, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    kept = F.array_join(F.filter(F.transform(pieces, lambda p, i: F.when(F.array_contains(gone, i + 1), F.lit(None)).otherwise(p)), lambda p: p.isNotNull()), "")
    return restored(found.withColumn("text", F.when(clean, F.col("text")).otherwise(F.concat(kept, tail))), docs)
