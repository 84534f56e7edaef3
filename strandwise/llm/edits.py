"""Edit-aware token counts over trees of pre-token segments.

A text is cut before every single space between two characters that aren't white space: byte-level
pre-tokenizers always start a piece there, so the pieces' counts add up to the text's. Segments are
grouped into leaves of a binary tree that holds the characters and tokens below each node. An edit
finds its leaves by descending over characters, counts again only what lies between the nearest
cuts that the edit leaves intact, and updates the sums above.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.text import lean

LEAF = 32
KNOWN, KNOWN_CHARS = 600_000, 64
_UNSAFE = re.compile(r"\s |^ | \s| $")
_COUNTERS: dict = {}


class Counter:
    """Token counts of segments by the library; up to ``KNOWN`` segments are remembered. Those of
    over ``KNOWN_CHARS`` characters are remembered for the texts at hand only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        self.long: list[str] = []

    def learn(self, segments: list[list[str]]) -> None:
        for s in self.long:
            self.known.pop(s, None)
        new = set().union(*segments).difference(self.known) if segments else set()
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = set().union(*segments)
        rest = list(new)
        self.long = [s for s in rest if len(s) > KNOWN_CHARS]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for s, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[s] = len(got)

    def counts(self, segments: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, segments))
        except KeyError:
            self.learn([segments])  # also those known: long ones may go
            return list(map(self.known.__getitem__, segments))


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def segments_of(text: str) -> list[str]:
    """The text cut before every space whose neighbours are both no white space."""
    pieces = text.split(" ")
    if not _UNSAFE.search(text):
        return [pieces[0], *(" " + p for p in pieces[1:])]
    out = [pieces[0]]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        if piece and before and not piece[0].isspace() and not before[-1].isspace():
            out.append(" " + piece)
        else:
            out[-1] += " " + piece
    return out


class TokenTree:
    """A text's leaves and the sums above them. encoded: characters counted again by edits."""

    def __init__(self, text: str, counts: Counter, segments: list[str] | None = None):
        self.counter, self.encoded = counts, 0
        self._build(segments_of(text) if segments is None else segments)

    def _build(self, segments: list[str]) -> None:
        tokens = self.counter.counts(segments)
        groups = range(0, len(segments), LEAF)
        self.leaves = ["".join(segments[k : k + LEAF]) for k in groups]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, low in enumerate(groups):
            self.chars[self.size + k] = len(self.leaves[k])
            self.tokens[self.size + k] = sum(tokens[low : low + LEAF])
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one at the end), and where it starts."""
        k, low = 1, 0
        while k < self.size:
            k *= 2
            if at >= low + self.chars[k] and self.chars[k + 1]:
                low += self.chars[k]
                k += 1
        return k - self.size, low

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = self.size + leaf
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces characters start:end (clipped to the text). Leaves beside the edit join in as
        long as the cut between them and the edited region is no cut any more."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        first, low = self._find(start)
        last, last_low = self._find(max(start, end - 1))
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - low] + replacement + old[end - low :]
        while True:
            before, after = self._beside(first, -1), self._beside(last, 1)
            if before is not None and not _cut(self.leaves[before][-1], new[:2]):
                first, new = before, self.leaves[before] + new
            elif after is not None and not (new and _cut(new[-1], self.leaves[after][:2])):
                last, new = after, new + self.leaves[after]
            else:
                break
        self.encoded += len(new)
        segments = segments_of(new)
        if len(segments) > 4 * LEAF and last - first < 2:
            self._build([s for k, leaf in enumerate(self.leaves) if not first < k <= last for s in (segments if k == first else segments_of(leaf) if leaf else [])])
            return
        self._set(first, new, sum(self.counter.counts(segments)))
        for k in range(first + 1, last + 1):
            self._set(k, "", 0)


def _cut(before: str, after: str) -> bool:
    return len(after) == 2 and after[0] == " " and not after[1].isspace() and not before.isspace()


def recount(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Counts every text's tokens and, after its edits, the edited text's, from the same tree.

    edits_col: array<struct<start int, end int, text string>>, applied in order, in code points of
    the text as edited so far; places beyond the text are clipped. Returns (id, n_tokens,
    edited_tokens, edited_chars, edited_crc32, encoded_chars): encoded_chars were counted again.
    Null texts, null edits and null replacements are empty; a null start is 0 and a null end its
    start; null ids come back null; repeated ids stay rows of their own; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts_ = [t or "" for t in part.column(1).to_pylist()]
                cuts = [segments_of(t) for t in texts_]
                counts.learn(cuts)
                out = []
                for text, segments, edits in zip(texts_, cuts, part.column(2).to_pylist(), strict=True):
                    tree = TokenTree(text, counts, segments)
                    n = tree.n_tokens
                    for e in edits or ():
                        if e:
                            start = e["start"] or 0
                            tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                    crc = 0
                    for leaf in tree.leaves:
                        crc = zlib.crc32(leaf.encode(), crc)
                    out.append((n, tree.n_tokens, tree.n_chars, crc, tree.encoded))
                cols = np.array(out, dtype=np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in cols)], names=[id_col, "n_tokens", "edited_tokens", "edited_chars", "edited_crc32", "encoded_chars"])

    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text"), F.col(edits_col).cast("array<struct<start:int,end:int,text:string>>").alias("edits"))
    return rows.mapInArrow(lean(run), f"`{id_col}` bigint, n_tokens bigint, edited_tokens bigint, edited_chars bigint, edited_crc32 bigint, encoded_chars bigint")


def with_sample_edits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with three edits of each text in column edits (in place of one they may have): a word put in at a quarter, the middle 16 characters
    replaced by the first 24, and the last 10 taken away."""
    n = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("int")
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("text"))
    return docs.withColumn("edits", F.array(edit(F.floor(n / 4), F.floor(n / 4), F.lit(" edited")), edit(F.floor(n / 2), F.floor(n / 2) + 16, F.substring(text_col, 1, 24)), edit(n - 10, F.lit(1 << 30), F.lit(""))))
