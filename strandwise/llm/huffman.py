"""Canonical length-limited Huffman coding of token ids.

Code lengths come from global id counts by package-merge. A block is coded on its own: its bits
are cut into lanes of ``LANE`` ids, and a checkpoint holds the bit offset at which each lane
starts. Decoding looks ids up in a table of all bit patterns of the longest code; the lanes of a
block advance together, so the work is a few array operations per id of a lane.

Block layout (little-endian): magic ``SWH1``; u32 documents; u64 ids; u64 ids before the block in
its part; u64 bits; i64 document ids; u32 ids of each document; u32 bits of each lane; the bits,
most significant first, padded by 8 bytes.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"SWH1"
HEAD = struct.Struct("<4sIQQQ")
LANE = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (0: unused), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    if n < 2:
        out[used] = 1
        return out
    order = np.argsort(counts[used], kind="stable")
    weight = counts[used][order].astype(np.int64)
    now, leaves = weight, []
    for _ in range(limit - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        leaves.append(rank < n)
        now = both[rank]
    length, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    length[:take] += 1
    out[used[order]] = length
    return out


def bit_limit(n_used: int) -> int:
    """Bits that leave the code within a percent of optimal and its table small."""
    return min(24, max(12, int(np.ceil(np.log2(max(2, n_used)))) + 4))


class Code:
    """Codes and decoding table of given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = self.lengths[order]
        self.most = int(size.max(initial=1))
        span = np.int64(1) << (self.most - size)
        start = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (start >> (self.most - size)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.most, dtype=np.uint32)
        self.size = np.ones(1 << self.most, dtype=np.uint8)
        total = int(span.sum())
        self.symbol[:total] = np.repeat(order, span)
        self.size[:total] = np.repeat(size, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The bits, the bits of each lane, and how many bits there are."""
        size = self.lengths[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        end = np.cumsum(size)
        bits = int(end[-1]) if len(ids) else 0
        lanes = np.add.reduceat(size, np.arange(0, len(ids), LANE)) if len(ids) else size
        start = end - size
        word = start >> 5
        value = self.codes[ids] << (np.uint64(64) - (start & 31).astype(np.uint64) - size.astype(np.uint64))
        out = np.zeros(bits // 32 + 3, dtype=np.uint32)
        if len(ids):
            lead = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            both = np.bitwise_or.reduceat(value, lead)
            out[word[lead]] |= (both >> np.uint64(32)).astype(np.uint32)
            np.bitwise_or.at(out, word[lead] + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return out.astype(">u4").tobytes()[: (bits + 7) // 8] + bytes(8), lanes.astype("<u4"), bits

    def decode(self, data: np.ndarray, lanes: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block's padded bits."""
        out = np.zeros((LANE, len(lanes)), dtype=np.uint32)
        b = data.astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at = np.cumsum(lanes, dtype=np.int64) - lanes
        last, shift = len(window) - 1, np.uint32(32 - self.most)
        for k in range(min(LANE, n)):
            entry = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[k] = self.symbol[entry]
            at += self.size[entry]
        return out.T.reshape(-1)[:n]


def write_block(code: Code, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    bits, lanes, n = code.encode(ids)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), before, n)
    return b"".join((head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), lanes.tobytes(), bits))


def read_block(code: Code, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, ids of each document, the ids, and the ids before the block in its part."""
    magic, docs, n, before, bits = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    counts = np.frombuffer(block, "<u4", docs, at := at + 8 * docs)
    lanes = np.frombuffer(block, "<u4", -(-n // LANE), at := at + 4 * docs)
    data = np.frombuffer(block, np.uint8, (bits + 7) // 8 + 8, at + 4 * len(lanes))
    return doc_ids, counts, code.decode(data, lanes, n), before
