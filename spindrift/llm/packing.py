"""Best-fit packing of documents into sequences, shrunk first by Martello-Toth dominance.

Token counts are bounded by the sequence length, so any number of documents is an instance of at most `capacity`
distinct item sizes with multiplicities. Spark counts the sizes, the driver packs the histogram (its work and memory
depend on the capacity only, never on the number of documents), and Spark deals the resulting places out again.

Dominance (Martello and Toth): with the largest remaining item j and residual r = capacity - j, the set {j, a} with a
the largest item <= r dominates every other feasible set that holds j if a = r, or if no two items fit into r; {j}
dominates if none fits. Those sets are fixed for good, many equal ones at a time, until none applies. Best-fit
decreasing packs the rest, again many equal items at a time.

Cases: a null or empty text is the end token alone; a text of any length is cut into pieces of the capacity; equal rows
are packed one by one; an empty table gives an empty result; columns beyond `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, os_nice_threads, partitions, texts, tidy

CAPACITY = 4096
END = 1

# --- tokens ---------------------------------------------------------------------------------------------------------

#: Chunks that the short way splits as the tokenizer does: ASCII but white space, and Latin-1 letters (stable under NFC).
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own pattern, on that alphabet.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_SPACE = re.compile(r"[ \n]+")
#: Stands for the end of a word; no byte of UTF-8.
_WORD_END = b"\xff"


class WordTokenizer:
    """Ids of a word-end BPE tokenizer file, by a table of chunks.

    White space is dropped by the tokenizer and no merge crosses it, so a text's ids are those of its chunks one after
    another. A new plain chunk is merged by byte ranks; any other chunk goes to the tokenizer itself.
    """

    LIMIT = 150_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os_nice_threads()
        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        shown = {c: bytes([b]) for b, c in _shown_bytes().items()}
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        ranks, self.id_of = {_WORD_END: 255}, {}
        single, joined = [], []
        for token, i in vocabulary.items():
            if token in special:
                continue
            end = token.endswith("</w>") and token != "</w>"
            raw = b"".join(shown[c] for c in (token[:-4] if end else token)) + (_WORD_END if end else b"")
            (single if len(raw) == 1 else joined).append((i, raw))
        ranks |= {raw: n for n, (_, raw) in enumerate(sorted(single, key=lambda x: x[1]))}
        ranks[_WORD_END] = len(ranks) - 1 if _WORD_END in ranks else len(ranks)
        first = max(ranks.values()) + 1
        # a byte and the word's end are one symbol from the start: they merge before all else
        joined.sort(key=lambda x: (not (len(x[1]) == 2 and x[1].endswith(_WORD_END)), x[0]))
        for n, (_, raw) in enumerate(joined):
            ranks[raw] = first + n
        ids = np.zeros(first + len(joined), np.int64)
        for i, raw in single + joined:
            ids[ranks[raw]] = i
        self.ids = ids.tolist()
        self.merge = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, list[int]] = {}

    def _chunk(self, chunk: str) -> list[int]:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids, merge = self.ids, self.merge
            out = [ids[t] for piece in _PIECES.findall(chunk.lower()) for t in merge(piece.encode() + _WORD_END)]
        else:
            out = self.whole.encode(chunk, add_special_tokens=False).ids
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            ids, merge = self.ids, self.merge
            for piece in _PIECES.findall(text.lower()):
                got = known.get(piece)
                if got is None:
                    got = [ids[t] for t in merge(piece.encode() + _WORD_END)]
                    if len(piece) < 32:
                        if len(known) >= self.LIMIT:
                            known.clear()
                        known[piece] = got
                out += got
            return out
        for chunk in _SPACE.split(text):
            if chunk:
                out += self._chunk(chunk)
        return out


def _shown_bytes() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself where it is one, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids and the end id; `ids` only on request."""
    schema = PIECES if with_ids else pa.schema(list(PIECES)[:-1])

    def cut(batches):
        encode = word_tokenizer(tokenizer).encode
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = np.array([*encode(text), END], np.uint32)
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc, n, start, len(part), zlib.crc32(part.astype("<u4").tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    types = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), types)


# --- the instance ---------------------------------------------------------------------------------------------------


class Plan:
    """Sequences of equal make-up: `times` sequences from number `base` on hold items of these lengths, in this order."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.rows.append((lengths, self.sequences, times))
            self.sequences += times

    def slots(self) -> np.ndarray:
        """(length, first rank, end rank, base, offset): the items of this length with those ranks go to base, base + 1, ..."""
        used, out = defaultdict(int), []
        for lengths, base, times in self.rows:
            offset = 0
            for n in lengths:
                out.append((n, used[n], used[n] + times, base, offset))
                used[n] += times
                offset += n
        return np.array(sorted(out), np.int64).reshape(-1, 5)


def dominated(counts: np.ndarray, plan: Plan) -> None:
    """Fix the sets that dominate all others with the largest item, as long as there are such; `counts` shrinks."""
    capacity = plan.capacity
    for j in range(capacity, 0, -1):
        while counts[j]:
            r = capacity - j
            if r and counts[r] and (j != r or counts[j] >= 2):  # a perfect fit
                n = int(counts[j] // 2 if j == r else min(counts[j], counts[r]))
                counts[j] -= n
                counts[r] -= n
                plan.add((j, r), n)
                continue
            rest = counts[: r + 1].copy()
            if j <= r:
                rest[j] -= 1
            fits = np.flatnonzero(rest)
            if not len(fits):
                n = int(counts[j]) if j > r else 1
                counts[j] -= n
                plan.add((j,), n)
                continue
            smallest = int(fits[0])
            second = smallest if rest[smallest] >= 2 else int(fits[1]) if len(fits) > 1 else capacity
            if smallest + second > r:  # one at most fits beside j
                a = int(fits[-1])
                n = 1 if j <= r else int(min(counts[j], counts[a]))
                counts[j] -= n
                counts[a] -= n
                plan.add((j, a), n)
                continue
            break  # nothing dominates here; a smaller item may still have its perfect partner


def best_fit(counts: np.ndarray, plan: Plan) -> None:
    """Best-fit decreasing over what is left: equal sequences and equal items are handled together."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(plan.capacity + 1)]  # by residual
    for n in range(plan.capacity, 0, -1):
        left, residual = int(counts[n]), n
        while left:
            while residual <= plan.capacity and not open_[residual]:
                residual += 1
            if residual > plan.capacity:
                each = plan.capacity // n
                full, rest = divmod(left, each)
                if full:
                    open_[plan.capacity - each * n].append(((n,) * each, full))
                if rest:
                    open_[plan.capacity - rest * n].append(((n,) * rest, 1))
                break
            lengths, times = open_[residual].pop()
            each = residual // n
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            if full:
                open_[residual - each * n].append((lengths + (n,) * each, full))
            if rest:
                open_[residual - rest * n].append((lengths + (n,) * rest, 1))
            if times - full - bool(rest):
                open_[residual].append((lengths, times - full - bool(rest)))
            left -= full * each + rest
        counts[n] = 0
    for groups in open_:
        for lengths, times in groups:
            plan.add(lengths, times)


def plan_of(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    plan, counts = Plan(capacity), counts.copy()
    dominated(counts, plan)
    best_fit(counts, plan)
    return plan


# --- dealing out ----------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and place in it.

    Ranks within a length are dealt by salted groups (length, salt): a length that a third of all pieces have is spread
    over all tasks. The table of places is bounded by the capacity, not by the documents, and travels with the tasks.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity, with_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(64, partitions(spark))))), "pieces")
    groups = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"]).select("length", "salt", "before")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    slots = plan_of(counts, capacity).slots()
    key = slots[:, 0] * (1 << 48) + slots[:, 1]
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    placed = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = slots[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            b = b.drop_columns(["rank"]).append_column("sequence_id", pa.array(slot[:, 3] + rank - slot[:, 1])).append_column("offset", pa.array(slot[:, 4]))
            yield b

    order = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank"]
    types = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return placed.select(*order).mapInArrow(place, types)
