"""Phrase collocations: counts of all n-grams, the weakest cut of each, and the best of every language.

Texts have A-Z lower-cased, are cut into pieces at . , ; : ! ? and line ends, and pieces into words at blanks and tabs. Every 1- to
max_n-gram within a piece becomes a row (lang, phrase, n): a task counts those of some megabytes of text by numbering words and then,
one word more at a time, grams; Spark adds the rows up by a hash aggregation. The empty phrase has a row too: it is the gram of
no words, which stands once for each word, so its count is the number of a language's words. Then, on phrases that are frequent enough,

- each phrase of two or more words is cut after every word and meets the counts of both parts by joins; both are frequent, as
  they occur wherever the phrase does; scores are divided as decimals of 38 digits, which are exact up to counts of 10^16;
- a phrase goes if one that is longer by one word, and occurs nearly as often, has it inside. Longer ones need no look: what occurs
  `cover` percent as often has a part of one word more that does so too, and that part is as frequent, so it was looked at;
- ranks are cut first within hash buckets of a language, then within fewer of them, then in the language, so that no task sorts more
  than some multiples of `limit`, apart from the buckets.

A phrase that is everywhere is one row of each few megabytes before the shuffle. The join with the first or the last word's count can
have many phrases on one key; these are inner joins of two shuffled sides, which adaptive execution splits.

Cases: a null text is empty; a null lang is `und` and counts with those named so; repeated rows count again; texts without words and
empty tables give no rows; further columns are ignored; a text of any length is read whole, in one task; ties in score and count go by the
phrase's bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, tidy

MAX_N, MIN_COUNT, COVER, LIMIT = 3, 10, 50, 2_000
NO_LANG = "und"
#: Bytes of text that are counted at a time, and that are cut into words at a time (a longer text is at once), and rows of a batch that leaves a task.
CHUNK, STEP, OUT = 32 << 20, 2 << 20, 1 << 16
#: Partitions of phrases for each one of the session's shuffles: phrases are many more rows than texts.
SPREAD = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a byte is: part of a word, a blank between words, a mark between pieces.
_WORD, _BLANK, _MARK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _MARK

ROWS = pa.schema([("name", pa.string()), ("n", pa.int64())])


def _words(data: np.ndarray, begin: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts that lie one behind another: the words, the piece and the text of each. `begin`: where the texts begin."""
    data = _LOWER[data]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == _WORD
    opens = np.zeros(len(data) + 1, bool)
    opens[begin] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | opens[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | opens[1:])) + 1
    piece = np.searchsorted(np.flatnonzero((kind == _MARK) | opens[:-1]), start, "right")
    text = np.searchsorted(begin, start, "right") - 1
    ends = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside[1:-1]]))
    return words, piece, text


def _read(data: np.ndarray, begin: np.ndarray, number: np.ndarray) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """All words of some texts, with a number of their piece and of their language; bytes are looked at a few megabytes at a time."""
    found, pieces, langs, seen = [], [], [], 0
    i, end = 0, np.append(begin[1:], len(data))
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + STEP, "right")))
        words, piece, text = _words(data[begin[i] : end[j - 1]], begin[i:j] - begin[i])
        found.append(words)
        pieces.append((piece + seen).astype(np.int32))
        langs.append(number[i:j][text])
        seen += int(piece[-1]) + 1 if len(piece) else 0
        i = j
    return pa.chunked_array(found, pa.large_string()), np.concatenate(pieces), np.concatenate(langs)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers from 0 of equal keys in the keys' order, the key of each number, and how often it occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - 1
    start = np.flatnonzero(first)
    return number, keys[start], np.diff(start, append=len(keys))


def grams(data: np.ndarray, begin: np.ndarray, number: np.ndarray, langs: pa.Array, max_n: int):
    """(names, counts) of all grams of some texts, in batches.

    A name is the language, a tab and the phrase. `number` has the place in `langs` of each text's language. Words and then
    grams are numbered in the order of their names, so that neighbours share beginnings, which a shuffle can compress.
    """
    words, piece, lang = _read(data, begin, number)
    if not len(words):
        return
    tab, blank, langs = pa.scalar("\t", pa.large_string()), pa.scalar(" ", pa.large_string()), langs.cast(pa.large_string())
    total = np.bincount(lang, minlength=len(langs))
    yield pc.binary_join_element_wise(langs, pa.scalar("", pa.large_string()), tab).filter(pa.array(total > 0)), total[total > 0]
    words = words.dictionary_encode().combine_chunks()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    word, known, size = place[words.indices.to_numpy()], words.dictionary.take(pa.array(order)), len(order)
    del words, place
    # the grams of n - 1 words: their names, and the number of the one at each word in `at`
    names, gram, at, joint = langs, lang, np.arange(len(word), dtype=np.int32), tab
    for n in range(1, max_n + 1):
        if n > 1:
            inside = at < len(word) - n + 1
            inside[inside] = piece[at[inside]] == piece[at[inside] + (n - 1)]
            gram, at, joint = gram[inside], at[inside], blank
            del inside
        if not len(at):
            return
        gram, keys, count = _numbered(gram.astype(np.int64) * size + word[at + (n - 1)])
        made = []
        for k in range(0, len(keys), OUT):
            some = keys[k : k + OUT]
            name = pc.binary_join_element_wise(names.take(pa.array(some // size)), known.take(pa.array(some % size)), joint)
            yield name, count[k : k + OUT]
            if n < max_n:
                made.append(name)
        names = pa.chunked_array(made, pa.large_string()).combine_chunks() if made else None


def _reader(max_n: int):
    def read(batches):
        for batch in batches:
            lang, text = batch.column(0).dictionary_encode(), batch.column(1)
            number = lang.indices.to_numpy()
            offset = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(text):
                j = max(i + 1, int(np.searchsorted(offset, offset[i] + CHUNK, "right")) - 1)
                for name, n in grams(data[offset[i] : offset[j]], offset[i:j] - offset[i], number[i:j], lang.dictionary, max_n):
                    yield pa.RecordBatch.from_arrays([name.cast(pa.string()), pa.array(n.astype(np.int64))], schema=ROWS)
                i = j

    return tidy(read)


def counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = 1) -> DataFrame:
    """(lang, phrase, n): how often each phrase of at most max_n words occurs, if `min_count` times; the empty phrase counts words."""
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(_reader(max_n), "name string, n long")
    # tasks have added up what recurs in some megabytes; adding up again before the shuffle would gain little, and spill
    dealt = found.repartition(SPREAD * partitions(docs.sparkSession), "name")
    summed = dealt.groupBy("name").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.endswith("name", F.lit("\t")))
    phrase = F.substring_index("name", "\t", -1)
    return summed.select(F.substr("name", F.lit(1), F.length("name") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "n")


def _joined(words: Column, at, n) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two or more words, at the cut with the least score."""
    words = F.col("words")
    cut = counted.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _joined(words, 1, F.col("k")).alias("first"), _joined(words, F.col("k") + 1, F.size(words)).alias("rest"))
    left = counted.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    exact = lambda c: f"cast({c} as decimal(20, 0))"
    score = F.expr(f"({exact('a')} * {exact('a')} * 1000000) div ({exact('l')} * {exact('r')})")
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(counted: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase) of those inside a phrase longer by one word that occurs at least `cover` percent as often."""
    words = F.col("words")
    longer = counted.select("lang", F.col("n").alias("longer"), F.split("phrase", " ", -1).alias("words")).where(F.size(words) > 2)
    inner = longer.select("lang", "longer", F.explode(F.array(_joined(words, 1, F.size(words) - 1), _joined(words, 2, F.size(words) - 1))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return counted.join(most, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("n") * cover).select("lang", "phrase")


def best(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each language with their `rank`, by score, count and phrase."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    many = partitions(found.sparkSession)
    for buckets in (many, math.isqrt(many)):
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, cover: int = COVER, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `limit` phrases of every language. `docs` has lang and text."""
    counted = materialise(counts(docs, max_n, min_count), "phrases")
    words = counted.where("phrase = ''").select("lang", F.col("n").alias("all_words"))
    found = scored(counted).join(covered(counted, cover), ["lang", "phrase"], "left_anti")
    return best(found, limit).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
