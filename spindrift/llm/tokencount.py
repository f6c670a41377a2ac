"""Edit-aware token counts: a segment tree of pre-token runs per document.

A text is cut into leaves of about `LEAF` characters at places that no pre-token crosses (before white space, before a mark
of a script without blanks, and where letters, numbers and marks of ASCII meet, as in JSON, addresses and code), so a text's tokens are those of its
leaves; a longer run without such a place, as of letters alone, is one pre-token and so one leaf. A complete binary tree holds the sums of characters and tokens. An edit (`cut` characters at `at` go, `put` comes) descends by characters to
the leaves it touches, takes in a neighbour where it reaches that leaf's first or last characters (the boundary
context), encodes that region again and updates the sums on the way up; all other leaves keep their counts. Insertions make
leaves longer; only when one has `GROWTH` times its size the tree's nodes are laid out anew, without encoding other leaves.

Documents and their edits are dealt by doc_id, sorted by the edits' order and streamed, so a document with very many
edits needs no more memory than its text.

Cases: null texts and null insertions are empty; an edit beyond the end applies at the end, a negative place at the
start; edits of unknown documents are ignored; rows with equal doc_id each get that id's edits; a null doc_id has no
edits; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

LEAF = 400
#: Leaves grow to so many times their size before the tree is built anew.
GROWTH = 4
#: Places that no pre-token crosses: before white space that follows something else; between a letter or number and a mark of scripts
#: that are written without blanks; and between letters, numbers and marks of ASCII, whichever come first, but for letters after an
#: apostrophe, which may be one token with it. Such a place depends on the two characters beside it alone.
_MARKS = r"!-/:-@\[-`{-~"
_SAFE = re.compile(
    r"(?<=\S)(?=[ \t\r\n])|(?<=[^\W_])(?=[。、，．！？；：「」『』（）《》…·—])"
    rf"|(?<=[A-Za-z])(?=[0-9{_MARKS}])|(?<=[0-9])(?=[A-Za-z{_MARKS}])|(?<=[{_MARKS}])(?=[0-9])|(?<=[{_MARKS}])(?<!')(?=[A-Za-z])"
)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """Counts the tokens of a text, by a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda text: len(core.encode_ordinary(text))


def leaves(text: str) -> list[str]:
    """The text, cut at safe places."""
    out, start = [], 0
    while len(text) - start > LEAF:
        found = _SAFE.search(text, start + LEAF)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


class TokenTree:
    """Sums of characters and tokens over leaves; node 1 is the root, node k has children 2k and 2k + 1."""

    def __init__(self, text: str, count):
        self.count, self.encoded = count, 0
        self._build(leaves(text))

    def _build(self, parts: list[str], counts: list[int] | None = None) -> None:
        self.width = 1
        while self.width < len(parts):
            self.width *= 2
        self.parts = parts + [""] * (self.width - len(parts))
        if counts is None:
            counts = [self._encode(p) for p in parts]
        self.chars = [0] * self.width + [len(p) for p in self.parts]
        self.tokens = [0] * self.width + counts + [0] * (self.width - len(parts))
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _encode(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text) if text else 0

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        k = leaf + self.width
        self.parts[leaf], self.chars[k], self.tokens[k] = text, len(text), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds this place, and the place's distance from the leaf's start."""
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.width, at

    @property
    def size(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)

    def edit(self, at: int, cut: int, put: str) -> None:
        at = min(max(at, 0), self.size)
        cut = min(max(cut, 0), self.size - at)
        if not cut and not put:
            return
        first, before = self._find(max(0, min(at, self.size - 1)))
        before += at - max(0, min(at, self.size - 1))
        last, within = self._find(max(0, min(at + cut, self.size - 1)))
        # boundary context: a leaf's start needs its first two characters and the last one before it
        while first > 0 and (before <= 1 or not self.parts[first]):
            first -= 1
            before += len(self.parts[first])
        while last + 1 < self.width and within >= len(self.parts[last]) - 2:
            last += 1
            within = -1 if self.parts[last] else 0
        region = "".join(self.parts[first : last + 1])
        new = leaves(region[:before] + put + region[before + cut :])
        room = last - first + 1
        if len(new) > room:
            # no more leaves than there were, of about the same number of parts each
            new = ["".join(new[k * len(new) // room : (k + 1) * len(new) // room]) for k in range(room)] if sum(map(len, new)) <= GROWTH * LEAF * room else new
        if len(new) <= room:
            for n in range(room):
                part = new[n] if n < len(new) else ""
                self._set(first + n, part, self._encode(part))
        else:
            keep = self.tokens[self.width :]
            counts = keep[:first] + [self._encode(p) for p in new] + keep[last + 1 :]
            parts = self.parts[:first] + new + self.parts[last + 1 :]
            both = [(p, c) for p, c in zip(parts, counts) if p] or [("", 0)]
            self._build([p for p, _ in both], [c for _, c in both])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_chars_edited", pa.int64()), ("n_encoded", pa.int64()), ("text", pa.string())])


def counted(docs: DataFrame, edits: DataFrame, path: str, pattern: str, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, n_encoded): counts before and after all edits.

    `edits`: (doc_id, seq, at, cut, put), applied by seq, each to the text as the ones before have left it. `n_encoded` is the
    number of characters that the edits had encoded again. With `with_text`, the edited text too.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("seq"), F.lit(0).alias("at"), F.lit(0).alias("cut"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("put"), F.lit(0).alias("kind"))
    theirs = edits.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("seq").cast("long"), F.col("at").cast("int"), F.col("cut").cast("int"), F.coalesce("put", F.lit("")), F.lit(1))
    schema = RESULT if with_text else pa.schema(list(RESULT)[:-1])

    def run(batches):
        count = encoder(path, pattern)
        doc, trees = None, []

        def out():
            rows = [(doc, n, edited, t.total, t.size, t.encoded, *([t.text()] if with_text else [])) for n, edited, t in trees]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        held = []
        for b in batches:
            for i, at, cut, put, kind in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    if trees and (i != doc or i is None):
                        held.append(out())
                        trees = []
                    doc = i
                    tree = TokenTree(put, count)
                    tree.encoded = 0
                    trees.append([tree.total, 0, tree])
                elif i == doc and trees:
                    for t in trees:
                        t[1] += 1
                        t[2].edit(at or 0, cut or 0, put)
                if len(held) >= 1000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if trees:
            held.append(out())
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    types = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_encoded long" + (", text string" if with_text else "")
    dealt = own.union(theirs).repartition(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "kind", "seq", "at", "cut", "put")
    return dealt.select("doc_id", "at", "cut", "put", "kind").mapInArrow(run, types)
