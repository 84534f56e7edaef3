"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE, B a piece BPE that writes a space as U+2581 and unknown characters as bytes.
A text with a space before it is cut by both; where both end at the same byte the text falls into
groups, and an A and a B token are linked where their bytes overlap. A slice of an Arrow batch is
one run of bytes: the ends of all its tokens are counted once by byte (``bincount``), a group ends
where both counts are set, and differences of prefix sums at the texts' offsets give each text's
figures. Between two neighbouring ends one A and one B token overlap, so the ends of either also
list all links.

How many documents hold a pair linked is counted over the whole corpus: each task counts its blocks'
different pairs, sums are shuffled by buckets of A ids, and each block gets the counts of its own
pairs back. Neither the texts nor the links are shuffled by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, cut, partitions
from strandwise.llm.text import lean, parts, slices, span_hashes, texts

KNOWN = 1_500_000
BLOCK = 24 << 20
SLICE = 2 << 20
BUCKETS_A_PARTITION = 4
_STATE: dict[tuple, Cutter] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters stand
    for themselves, the other bytes in ascending order for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Cutter:
    """Both tokenizers with a memory of the segments they have cut.

    A segment starts at each space that follows a visible character (and at the text's start, where a
    space is added). Neither tokenizer has a token across such a place: A's pre-tokenizer cuts before
    a space that follows a visible character, and no piece of B has U+2581 behind another character
    (checked on loading). So a text's tokens are those of its segments, each of which goes through the
    libraries once per worker. ``KNOWN`` segments are held, then the memory starts again.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.space = self.b.piece_to_id("▁")  # what a text's last space is; the library has nothing for an empty text
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces run across spaces, so segments can't be cut on their own")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.digits_a, self.digits_b = _digits(len(self.bytes_a)), _digits(len(self.bytes_b))
        self._clear()

    def _clear(self) -> None:
        zero = np.zeros(0, dtype=np.uint64)
        self.keys, self.check, self.sound = zero, zero, np.zeros(0, dtype=bool)
        self.low = [np.zeros(0, dtype=np.int64)] * 2
        self.count = [np.zeros(0, dtype=np.int32)] * 2
        self.ids = [np.zeros(0, dtype=np.int32)] * 2

    def _learn(self, keys: np.ndarray, check: np.ndarray, spans: list[str]) -> None:
        """Adds segments under their (ascending) keys."""
        cut_a: list[list[int]] = []
        cut_b: list[list[int]] = []
        for k in range(0, len(spans), 4096):
            part = spans[k : k + 4096]
            cut_a += [got.ids for got in self.a.encode_batch_fast(part, add_special_tokens=False)]
            cut_b += [ids if s != " " else [self.space] for s, ids in zip(part, self.b.encode([s[1:] for s in part], num_threads=1), strict=True)]
        raw = [s.encode() for s in spans]
        sound = np.array([b"".join(map(self.bytes_a.__getitem__, a)) == s == b"".join(map(self.bytes_b.__getitem__, b)) for s, a, b in zip(raw, cut_a, cut_b, strict=True)], dtype=bool)
        at = np.searchsorted(self.keys, keys)
        for k, found in enumerate((cut_a, cut_b)):
            size = np.array([len(x) for x in found], dtype=np.int32)
            low = len(self.ids[k]) + np.cumsum(size) - size
            self.ids[k] = np.concatenate([self.ids[k], np.array([i for x in found for i in x], dtype=np.int32)])
            self.low[k], self.count[k] = np.insert(self.low[k], at, low), np.insert(self.count[k], at, size)
        self.keys, self.check, self.sound = np.insert(self.keys, at, keys), np.insert(self.check, at, check), np.insert(self.sound, at, sound)

    def tokens(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids of the texts one after another, the texts' first A and first B token, and
        the bytes before each text (counting its own space). A text that isn't to be cut, being empty
        or not what its tokens spell, has no tokens and no bytes."""
        buf = np.frombuffer(b"".join(b" " + d for d in docs), dtype=np.uint8)
        size = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        start = segment_starts(buf, edge)
        end = np.append(start[1:], len(buf))
        place = self._places(buf, start, end)
        first = np.searchsorted(start, edge)  # a text's first segment
        bad = np.concatenate([[0], np.cumsum(~self.sound[place])])
        good = (size > 1) & (bad[first[1:]] == bad[first[:-1]])
        place = place[np.repeat(good, np.diff(first))]
        before = np.concatenate([[0], np.cumsum(np.where(good, np.diff(first), 0))])
        out = []
        for k in (0, 1):
            count = self.count[k][place].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(count)])
            out.append((self.ids[k][np.repeat(self.low[k][place] - total[:-1], count) + np.arange(total[-1])], total[before]))
        return out[0][0], out[1][0], out[0][1], out[1][1], np.concatenate([[0], np.cumsum(np.where(good, size, 0))])

    def _places(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        key, check = span_hashes(buf, start, end), span_hashes(buf, start, end, 1)
        while True:
            keys, first, place = np.unique(key, return_index=True, return_inverse=True)
            if len(self.keys) + len(keys) > KNOWN:
                self._clear()
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), dtype=bool)
            there = at < len(self.keys)
            new[there] = self.keys[at[there]] != keys[there]
            if new.any():
                raw, pick = buf.tobytes(), first[new]
                self._learn(keys[new], check[pick], [raw[a:b].decode() for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)])
                at = np.searchsorted(self.keys, keys)
            other = self.check[at][place] != check
            if not other.any():
                return at[place]
            key = np.where(other, key * np.uint64(3) + check, key)  # segments that share a hash get another one


def segment_starts(buf: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where segments start in texts that each begin at an edge with a space: there, and at each space
    behind a visible ASCII character or a letter of two bytes from U+00C0 to U+00FF."""
    visible = (buf > 0x20) & (buf < 0x7F)
    visible[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80)
    begins = np.zeros(len(buf), dtype=bool)
    begins[1:] = visible[:-1] & (buf[1:] == 0x20)
    begins[edge[:-1]] = True
    return np.flatnonzero(begins)


def cutter(path_a: str, path_b: str) -> Cutter:
    """One pair of tokenizers per worker process."""
    if (path_a, path_b) not in _STATE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _STATE[path_a, path_b] = Cutter(path_a, path_b)
    return _STATE[path_a, path_b]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..n-1 (6 or more columns, left-aligned) and how many each has."""
    width = max(6, len(str(n)))
    text = np.array([str(k).ljust(width) for k in range(n)], dtype=f"S{width}")
    return text.view(np.uint8).reshape(n, width), np.array([len(str(k)) for k in range(n)], dtype=np.int64)


class Aligned:
    """The alignment of a slice of texts, by text.

    n_a, n_b, n_groups, n_links: figures; pairs, text, times: each text's different linked pairs
    (A id * n_b_ids + B id), ascending within the text, and how often each is linked there.
    """

    def __init__(self, cut_: Cutter, docs: list[bytes]):
        self.cutter = cut_
        self.a, self.b, self.first_a, self.first_b, self.edge = cut_.tokens(docs)
        end_a, end_b = np.cumsum(cut_.size_a[self.a]), np.cumsum(cut_.size_b[self.b])
        n = int(self.edge[-1])
        ends_a, ends_b = np.bincount(end_a, minlength=n + 1), np.bincount(end_b, minlength=n + 1)
        self.both = (ends_a > 0) & (ends_b > 0)  # by byte: a group ends here
        seen_a, seen_b, groups = np.cumsum(ends_a), np.cumsum(ends_b), np.cumsum(self.both)
        any_end = np.flatnonzero((ends_a > 0) | (ends_b > 0))
        links = np.searchsorted(any_end, self.edge, side="right")
        self.n_a, self.n_b, self.n_groups, self.n_links = np.diff(seen_a[self.edge]), np.diff(seen_b[self.edge]), np.diff(groups[self.edge]), np.diff(links)
        pair_a, pair_b = self.a[seen_a[any_end - 1]] if len(any_end) else self.a, self.b[seen_b[any_end - 1]] if len(any_end) else self.b
        pair = pair_a.astype(np.int64) * len(cut_.bytes_b) + pair_b
        text = np.repeat(np.arange(len(docs)), self.n_links)
        bits = int(len(cut_.bytes_a) * len(cut_.bytes_b)).bit_length()
        code, self.times = np.unique(text << bits | pair, return_counts=True)
        self.text, self.pairs = code >> bits, code & ((1 << bits) - 1)

    def group_texts(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2``: the tokens of both sides are dealt to their groups
        by one stable sort and their digits and separators written into one buffer."""
        end_a, end_b = np.cumsum(self.cutter.size_a[self.a]), np.cumsum(self.cutter.size_b[self.b])
        group_ends = np.flatnonzero(self.both)
        in_a, in_b = np.searchsorted(group_ends, end_a), np.searchsorted(group_ends, end_b)
        order = np.argsort(np.concatenate([in_a * 2, in_b * 2 + 1]), kind="stable")
        side = np.concatenate([in_a * 2, in_b * 2 + 1])[order]
        (digits_a, width_a), (digits_b, width_b) = self.cutter.digits_a, self.cutter.digits_b
        width = np.concatenate([width_a[self.a], width_b[self.b]])[order]
        digits = np.concatenate([digits_a[self.a], digits_b[self.b]])[order]
        after = np.full(len(order), ord(","), dtype=np.uint8)
        if len(order):
            turn = np.flatnonzero(side[1:] != side[:-1])
            after[turn] = np.where(side[turn] & 1, ord(";"), ord("|"))
        table = np.full((len(order), digits.shape[1] + 1), 0, dtype=np.uint8)
        table[:, :-1] = digits
        table[np.arange(len(order)), width] = after
        keep = np.arange(table.shape[1])[None, :] <= width[:, None]
        flat = table[keep].tobytes()
        low = np.concatenate([[0], np.cumsum(width + 1)])
        first = low[self.first_a + self.first_b]
        return [flat[x : y - 1] if y > x else b"" for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


class _Block:
    """The texts of a block: figures by text, and the links by text and pair."""

    def __init__(self) -> None:
        self.size, self.n, self.held = 0, 0, []

    def add(self, ids: list, one: Aligned, size: int) -> None:
        sha = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(one.group_texts(), one.n_a.tolist(), strict=True)]
        self.held.append((ids, np.stack([one.n_a, one.n_b, one.n_groups, one.n_links], axis=1), sha, one.text + self.n, one.pairs, one.times))
        self.n += len(ids)
        self.size += size

    def close(self, number: int, n_b_ids: int, buckets: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The block's row and its rows of different pairs by bucket (of A ids)."""
        ids = [i for x in self.held for i in x[0]]
        figures = np.concatenate([x[1] for x in self.held]).astype("<i8")
        sha = [s for x in self.held for s in x[2]]
        text, pairs, times = (np.concatenate([x[k] for x in self.held]) for k in (3, 4, 5))
        own, place = np.unique(pairs, return_inverse=True)
        documents = np.bincount(place, minlength=len(own)).astype("<i8")
        bucket = own // n_b_ids % buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(own), dtype=np.int64)
        rank[order] = np.arange(len(own))  # a pair's place when buckets stand one after another
        row = {"block": [number], "ids": [ids], "sha": [sha], "figures": [figures.tobytes()], "links": [np.bincount(text, minlength=self.n).astype("<i4").tobytes()], "place": [rank[place].astype("<i4").tobytes()], "times": [times.astype("<i4").tobytes()]}
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(own)]]) if len(own) else np.zeros(1, dtype=np.int64)
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        sorted_pairs, sorted_docs = own[order].astype("<i8"), documents[order]
        asked = {"block": [number] * len(spans), "bucket": [int(bucket[order[x]]) for x, _ in spans], "pairs": [sorted_pairs[x:y].tobytes() for x, y in spans], "documents": [sorted_docs[x:y].tobytes() for x, y in spans]}
        fill = lambda cols: pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(cols["block"]), f.type) for f in _ROWS], schema=_ROWS)
        return fill(row), fill(asked)


_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("documents", pa.binary()), ("ids", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("figures", pa.binary()), ("links", pa.binary()), ("place", pa.binary()), ("times", pa.binary())])
_DDL = "block bigint, bucket int, pairs binary, documents binary, ids array<bigint>, sha array<string>, figures binary, links binary, place binary, times binary"


def _blocks(held: DataFrame, path_a: str, path_b: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_ = cutter(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in parts(batches):
            ids, docs = batch.column(0).to_pylist(), texts(batch.column(1))
            for x, y in slices([len(d) for d in docs], SLICE):
                block.add(ids[x:y], Aligned(cut_, docs[x:y]), sum(map(len, docs[x:y])))
                if block.size >= BLOCK:
                    yield from block.close(number, len(cut_.bytes_b), buckets)
                    number, block = number + 1, _Block()
        if block.n:
            yield from block.close(number, len(cut_.bytes_b), buckets)

    return held.mapInArrow(lean(run), _DDL)


def _totals(asked: DataFrame, n_b_ids: int) -> DataFrame:
    """(bucket, pairs, counts, best) over all blocks: ascending pairs, in how many documents each is
    linked, and whether no pair of its A id is in more. Tasks add up what they read before anything is
    shuffled, so a bucket gets a row from each task."""

    def add_up(pairs: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pair, n = np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(counts), "<i8")
        own, place = np.unique(pair, return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, place, n)
        return own, total

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, p, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = held.setdefault(bucket, [])
                rows.append((p, n))
                if len(rows) >= 16:
                    own, total = add_up(*map(list, zip(*rows, strict=True)))
                    held[bucket] = [(own.tobytes(), total.tobytes())]
        for bucket, rows in held.items():
            own, total = add_up(*map(list, zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "pairs", "documents"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in combine(batches):
            own, total = np.frombuffer(batch.column(1)[0].as_py(), "<i8"), np.frombuffer(batch.column(2)[0].as_py(), "<i8")
            a = own // n_b_ids
            lead = np.flatnonzero(np.diff(a, prepend=-1))
            most = np.repeat(np.maximum.reduceat(total, lead), np.diff(np.append(lead, len(a))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([(total == most).tobytes()], pa.binary())], names=["bucket", "all_pairs", "counts", "best"])

    shape = "bucket int, pairs binary, documents binary"
    sent = asked.select("bucket", "pairs", "documents").mapInArrow(lean(combine), shape)
    dealt = sent.repartition(partitions(asked.sparkSession), "bucket")
    return dealt.mapInArrow(lean(finish), "bucket int, all_pairs binary, counts binary, best binary")


def _answers(asked: DataFrame, totals: DataFrame) -> DataFrame:
    """(block, answers): for each block the counts and best marks of its pairs, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, best = [], []
            for p, own, n, b in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                at = np.searchsorted(np.frombuffer(own, "<i8"), np.frombuffer(p, "<i8"))
                counts.append(np.frombuffer(n, "<i8")[at].tobytes())
                best.append(np.frombuffer(b, bool)[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(best, pa.binary())], names=["block", "bucket", "counts", "best"])

    joined = asked.select("block", "bucket", "pairs").join(totals, "bucket").select("block", "bucket", "pairs", "all_pairs", "counts", "best")
    found = joined.mapInArrow(lean(run), "block bigint, bucket int, counts binary, best binary")
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "best"))).alias("answers"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    Strings of special tokens in a text are plain text. A null or empty text, and one whose A or B
    tokens don't spell a space and the text, has no tokens: zeros and an empty digest. A pair counts
    once per row, so rows that share an id count each and come back each. A null id comes back null.
    An empty table gives no rows. Other columns are not read.
    """
    cut_ = cutter(path_a, path_b)
    n_b_ids = len(cut_.bytes_b)
    held = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.col(text_col).alias("text"))
    buckets = min(len(cut_.bytes_a), BUCKETS_A_PARTITION * partitions(docs.sparkSession))
    rows = cut(_blocks(held, path_a, path_b, buckets))
    asked = rows.where("bucket IS NOT NULL")
    answers = _answers(asked, cut(_totals(asked, n_b_ids)))
    blocks = rows.where("bucket IS NULL").select("block", "ids", "sha", "figures", "links", "place", "times").join(answers, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            for k in range(batch.num_rows):
                ids, sha = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                figures = np.frombuffer(batch.column(3)[k].as_py(), "<i8").reshape(-1, 4)
                links, place, times = (np.frombuffer(batch.column(c)[k].as_py(), "<i4") for c in (4, 5, 6))
                got = batch.column(7)[k].as_py() or []
                counts = np.frombuffer(b"".join(x["counts"] for x in got), "<i8")
                best = np.frombuffer(b"".join(x["best"] for x in got), bool)
                edge = np.concatenate([[0], np.cumsum(links)])
                summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edge])  # noqa: B023, E731
                cols = [pa.array([None if i == NO_ID else i for i in ids], pa.int64()), *(pa.array(figures[:, c]) for c in range(4))]
                cols += [pa.array(summed(np.where(best[place], times, 0).astype(np.int64))), pa.array(summed(counts[place] * times)), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return blocks.mapInArrow(lean(run), f"`{id_col}` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
