"""Exact substring dedup of word windows by level-wise doubling.

Level one takes windows of half the length. A window of ``2 n`` words holds ``n + 1`` windows of
``n`` words; the one with the smallest hash (the leftmost of equals) is its anchor. Equal long
windows have equal anchors at equal offsets, so only anchors need counting: where an anchor's hash
occurs at one place only, no long window over it repeats. The survivors alone are extended to twice
the length, where their 128-bit hashes decide; no longer window can remove another word.

Both levels shuffle packed arrays. A mapper settles what repeats within its own rows, so it sends
one occurrence of a hash at most: a window that half of all texts share reaches a reducer once per
mapper, not once per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, cut, partitions
from strandwise.llm.text import Words, join_hashes, lean, mix, parts, slices, texts, window_hashes

WINDOW = 20
BUCKET_BITS = 12
FLUSH = 1 << 20
PACKED = "bucket int, local boolean, h binary, g binary, id binary, pos binary"
FOUND = "owner int, id binary, pos binary"


def _valid(words: Words, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` words within one text."""
    first = words.first
    n = np.maximum(words.counts() - length + 1, 0)
    low = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(low - first[:-1], n)


def _anchor_starts(h: np.ndarray, half: int, starts: np.ndarray) -> np.ndarray:
    """For each window of 2 * half words: where its anchor starts."""
    if not len(starts):
        return starts
    view = np.lib.stride_tricks.sliding_window_view(h, half + 1)
    return starts + view.argmin(axis=1)[starts]


def _pack(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows for the reducers and local finds: cols are h, g (empty at level one), id, pos."""
    h, g, ids, pos = cols
    order = np.lexsort((pos, ids, g, h)) if len(g) else np.lexsort((pos, ids, h))
    h, ids, pos = h[order], ids[order], pos[order]
    g = g[order] if len(g) else g
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    if len(g):
        new[1:] |= g[1:] != g[:-1]
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    if len(g):  # found: every later place of what also starts earlier here
        found = (ids != ids[lead][group]) | (pos != pos[lead][group])
    else:  # found: every place of what stands at two places here
        other = (ids != ids[lead][group]) | (pos != pos[lead][group])
        found = np.bincount(group, weights=other, minlength=len(lead))[group] > 0
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    yield from _rows(bucket[lead], False, h[lead], g[lead] if len(g) else g, ids[lead], pos[lead], bool(len(g)))
    at = np.flatnonzero(found)
    at = at[np.lexsort((pos[at], ids[at]))]
    yield from _rows(_owner(ids[at]), True, h[:0], g[:0], ids[at], pos[at], bool(len(g)))


def _rows(bucket: np.ndarray, local: bool, h: np.ndarray, g: np.ndarray, ids: np.ndarray, pos: np.ndarray, wide: bool) -> Iterator[pa.RecordBatch]:
    """One row per bucket. Level one sends 32 bits of a hash beside the bucket's 12: a chance
    match there only lets a candidate through that the next level drops."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, ids, pos = bucket[order], ids[order], pos[order]
    if not local:
        h = h[order] if wide else (h[order] >> np.uint64(20)).astype(np.uint32)
        g = g[order] if wide else g
    edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    n = len(edge) - 1
    yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.array([local] * n), cut(h), cut(g), cut(ids.astype("<i8")), cut(pos.astype("<i4"))], names=["bucket", "local", "h", "g", "id", "pos"])


def _owner(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _finds(ids: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Finds packed by groups of texts, so that a reducer's rows don't multiply with the texts."""
    if not len(ids):
        return
    owner = _owner(ids)
    order = np.lexsort((pos, ids, owner))
    owner, ids, pos = owner[order], ids[order], pos[order]
    edge = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
    spans = list(zip(edge[:-1], edge[1:], strict=True))
    cols = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (ids.astype("<i8"), pos.astype("<i4"))]
    yield pa.RecordBatch.from_arrays([pa.array(owner[edge[:-1]], pa.int32()), *cols], names=["owner", "id", "pos"])


def _by_text(found: DataFrame) -> DataFrame:
    """(id_, places): one row for each text with finds; places are packed int32, ascending."""

    def rows(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        ids = np.concatenate([np.frombuffer(a, "<i8") for a, _ in parts])
        pos = np.concatenate([np.frombuffer(b, "<i4") for _, b in parts])
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        edge = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        places = pa.array([pos[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids[edge[:-1]]), places], names=["id_", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for owner, ids, pos in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if owner != now and parts:
                    yield rows(parts)
                    parts = []
                now = owner
                parts.append((ids, pos))
        if parts:
            yield rows(parts)

    dealt = found.repartition(partitions(found.sparkSession), "owner").sortWithinPartitions("owner")
    return dealt.mapInArrow(lean(run), "id_ bigint, places binary")


class _Held:
    """Arrays of four columns that are packed whenever FLUSH rows are held."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(list(cols))
        self.n += len(cols[0])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            cols = [np.concatenate([p[k] for p in self.parts]) for k in range(4)]
            self.parts, self.n = [], 0
            yield from _pack(cols)


def _local(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word number in ``at``, and its place in that text."""
    text = np.searchsorted(words.first, at, side="right") - 1
    return text, at - words.first[text]


def _level_one(docs: DataFrame, half: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in parts(batches):
            ids, docs_ = batch.column(0).to_numpy(), texts(batch.column(1))
            for a, b in slices([len(d) for d in docs_]):
                words = Words(docs_[a:b])
                h = mix(window_hashes(words.hashes(), half))
                at = np.unique(_anchor_starts(h, half, _valid(words, 2 * half)))
                text, pos = _local(words, at)
                yield from held.add(h[at], h[:0], ids[a:b][text], pos)
        yield from held.flush()

    return docs.mapInArrow(lean(run), PACKED)


def _level_two(candidates: DataFrame, half: int) -> DataFrame:
    """candidates: id_, text and the places (packed int32) of its repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in parts(batches):
            ids, docs_, places = batch.column(0).to_numpy(), texts(batch.column(1)), batch.column(2).to_pylist()
            for a, b in slices([len(d) for d in docs_]):
                words = Words(docs_[a:b])
                one, two = words.hashes(), words.hashes(1)
                h, g = window_hashes(one, half), window_hashes(two, half)
                starts = _valid(words, 2 * half)
                live = np.zeros(len(h), dtype=bool)
                for k in range(a, b):
                    live[words.first[k - a] + np.frombuffer(places[k], dtype="<i4")] = True
                starts = starts[live[_anchor_starts(mix(h), half, starts)]]
                h, g = (mix(join_hashes(x, x, half))[starts] if len(starts) else x[:0] for x in (h, g))
                text, pos = _local(words, starts)
                if len(starts):
                    yield from held.add(h, g, ids[a:b][text], pos)
        yield from held.flush()

    return candidates.mapInArrow(lean(run), PACKED)


def _reduce(packed: DataFrame, wide: bool) -> DataFrame:
    """Level one's places of repeated hashes, or level two's later places, by text."""

    def settle(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([np.frombuffer(r[0], dtype="<u8" if wide else "<u4") for r in rows])
        ids = np.concatenate([np.frombuffer(r[2], dtype="<i8") for r in rows])
        pos = np.concatenate([np.frombuffer(r[3], dtype="<i4") for r in rows])
        g = np.concatenate([np.frombuffer(r[1], dtype="<u8") for r in rows]) if wide else h
        order = np.lexsort((pos, ids, g, h))
        h, g, ids, pos = h[order], g[order], ids[order], pos[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        group, lead = np.cumsum(new) - 1, np.flatnonzero(new)
        other = (ids != ids[lead][group]) | (pos != pos[lead][group])
        found = other if wide else np.bincount(group, weights=other, minlength=len(lead))[group] > 0
        return ids[found], pos[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, out, n = None, [], 0
        for batch in batches:
            for bucket, local, *cols in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if bucket != now and rows:
                    out.append(settle(rows))
                    n, rows = n + len(out[-1][0]), []
                now = bucket
                if local:
                    out.append((np.frombuffer(cols[2], dtype="<i8"), np.frombuffer(cols[3], dtype="<i4")))
                    n += len(out[-1][0])
                else:
                    rows.append(tuple(cols))
            if n >= FLUSH:
                yield from _finds(*(np.concatenate([x[k] for x in out]) for k in (0, 1)))
                out, n = [], 0
        if rows:
            out.append(settle(rows))
        if out:
            yield from _finds(*(np.concatenate([x[k] for x in out]) for k in (0, 1)))

    dealt = packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return _by_text(dealt.mapInArrow(lean(run), FOUND))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id_, places): for each text (id_, text) the places (packed int32) of its windows whose
    words also start earlier. Ids are unique. window: an even number of words."""
    if window < 2 or window % 2:
        raise ValueError("window is an even number of words")
    half = window // 2
    places = _reduce(_level_one(docs, half), False)
    return _reduce(_level_two(docs.join(places, "id_").select("id_", "text", "places"), half), True)


def _finish(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    schema = "id_ bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n_words, n_removed, sha, kept = [], [], [], []
            for text, places in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()  # bytes: at the same separators
                n_words.append(len(words))
                if places:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.frombuffer(places, dtype="<i4")
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = list(compress(words, stay.tolist()))
                n_removed.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=["id_", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return docs.mapInArrow(lean(run), schema)


def _numbered(held: DataFrame) -> DataFrame:
    """(id_, sha_, text, own): the different rows of held, numbered in the order of ids and digests."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=["id_", "sha_", "text", "own"])
            at += batch.num_rows

    once = held.groupBy("id_", "sha_").agg(F.first("text").alias("text"))
    dealt = once.repartitionByRange(partitions(held.sparkSession), "id_", "sha_").sortWithinPartitions("id_", "sha_")
    return cut(dealt.mapInArrow(lean(number), "id_ bigint, sha_ string, text string, own bigint"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Removes every word that a window of ``window`` words covers whose words also start earlier
    (in a smaller id, or earlier in the same text). Windows are judged on the input. Returns (id,
    n_words, n_removed, kept_sha256) and, with_text, the kept words joined by one space.

    A null or empty text, or one with fewer words than a window, keeps all its words. Rows that
    share an id come in the order of their texts' SHA-256; rows that also share the text count as
    one and have the same result. A null id counts as the smallest and comes back null. An empty
    table gives no rows.
    """
    held = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    back = F.when(F.col("id_") != F.lit(NO_ID), F.col("id_")).alias(id_col)
    if not held.groupBy("id_").count().where("count > 1").head(1):
        out = _removed(held, window, with_text)
        return out.select(back, *out.columns[1:])
    held = held.withColumn("sha_", F.sha2("text", 256))
    rows = _numbered(held)
    out = _removed(rows.select(F.col("own").alias("id_"), "text"), window, with_text).withColumnRenamed("id_", "own")
    names = out.columns[1:]
    each = held.select("id_", "sha_").join(rows.select("id_", "sha_", "own"), ["id_", "sha_"])
    return each.join(out, "own").select(back, *names)


def _removed(held: DataFrame, window: int, with_text: bool) -> DataFrame:
    return _finish(held.join(repeated_windows(held, window), "id_", "left").select("id_", "text", "places"), window, with_text)
