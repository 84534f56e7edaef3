"""Whole texts as numpy arrays: word spans, word hashes and Arrow plumbing shared by the operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Texts reach the functions as one
byte buffer in which every text is followed by a line feed, so no word ever spans two texts.
Buffers are cut into slices of about ``SLICE`` bytes: one worker's memory depends on the slice and
on its longest single text, not on the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 3 << 20
LONG = 64
U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes; nulls stay nulls."""
    return column.cast(pa.large_binary())


def texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null text is empty."""
    return [x or b"" for x in binary(column).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut to a number of rows, so that few texts are held as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def lean(run):
    """The mapper, giving freed memory back to the system at the end of each task: workers live as
    long as their executor and would otherwise keep the most that any of their tasks has used."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return mapper


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(sizes: list[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes together (one text at least)."""
    low, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > limit:
            yield low, k
            low, held = k, 0
        held += size + 1
    if low < len(sizes):
        yield low, len(sizes)


class Words:
    """Word spans of some texts.

    buf: the bytes; starts, ends: a span for each word; first: for text k the words
    ``first[k]:first[k + 1]`` are its own.
    """

    def __init__(self, docs: list[bytes], separator: np.ndarray = SEPARATOR, table: np.ndarray | None = None):
        buf = np.frombuffer(b"\n".join(docs) + b"\n", dtype=np.uint8)
        self.buf = buf = table[buf] if table is not None else buf
        inside = ~separator[buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        bounds = np.zeros(len(docs) + 1, dtype=np.int64)
        np.cumsum([len(d) + 1 for d in docs], out=bounds[1:])
        self.first = np.searchsorted(self.starts, bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.buf, self.starts, self.ends, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans ``buf[start:end]``; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are mixed into what came before, so that spans of one length up to eight
    bytes never collide; spans of over ``LONG`` bytes go through XXH3."""
    size = ends - starts
    h = mix(size.astype(U64) + U64((seed + 1) * GOLDEN % (1 << 64)))
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(memoryview(padded[starts[k] : ends[k]]), seed)
    return h


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` consecutive entries of h, by doubling: a window's hash is
    joined from those of its parts."""
    if len(h) < length:
        return np.zeros(0, dtype=np.uint64)
    built, out, done, block = 1, None, 0, h
    while True:
        if length & built:
            out = block if out is None else join_hashes(out, block, done)
            done += built
        if done == length:
            return out
        block = join_hashes(block, block, built)
        built *= 2


def join_hashes(a: np.ndarray, b: np.ndarray, len_a: int) -> np.ndarray:
    """Hashes of windows from those of their first len_a entries and of the rest."""
    n = min(len(a), len(b) - len_a)
    return mix(a[:n] * U64(GOLDEN) + b[len_a : len_a + n])
