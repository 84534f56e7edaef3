"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits; a bit is set where over half of the text's shingle hashes set
it. Two fingerprints link at ``RADIUS`` or fewer differing bits. Candidates come from the
pigeonring principle: cut 64 bits into a ring of 4 segments with differences d0..d3 that sum to at
most 3. Some segment i then has, for every chain length l, d_i + ... + d_(i+l-1) <= 3 l / 4: the
segment itself is equal, with the next it differs in one bit at most, with the next two in two at
most. The first two conditions become an equi-join key (the segment, and the half of its
successor that is equal), the rest is checked on the candidates before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, components, cut, fresh, partitions
from strandwise.llm.text import LOWER, Words, lean, mix, parts, slices, texts, window_hashes

RADIUS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
BLOCK = 512
M16, M8 = np.uint64(0xFFFF), np.uint64(0xFF)


def _single_spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with one space after each word, and each word's start and end there."""
    size = words.ends - words.starts
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    take = np.ones(len(out), dtype=bool)
    take[end] = False
    inside = np.zeros(len(words.buf) + 1, dtype=np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    out[take] = words.buf[np.cumsum(inside[:-1]).astype(bool)]
    return out, start, end


def fingerprint_texts(docs: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64). Shingles are space-joined words in lower case (A-Z), repeats
    included, hashed by XXH64; fewer words than a shingle: the whole sequence; none: zero."""
    words = Words(docs, table=LOWER)
    buf, start, end = _single_spaced(words)
    view, digest = memoryview(buf), xxhash.xxh64_intdigest
    out = np.zeros(len(docs), dtype=np.uint64)
    first, counts = words.first, words.counts()
    whole = np.flatnonzero((counts > 0) & (counts < shingle))
    for k in whole:
        out[k] = digest(view[start[first[k]] : end[first[k + 1] - 1]], seed)
    long = np.flatnonzero(counts >= shingle)
    if not len(long):
        return out
    at = np.concatenate([np.arange(first[k], first[k + 1] - shingle + 1) for k in long])
    hashes = np.array([digest(view[a:b], seed) for a, b in zip(start[at].tolist(), end[at + shingle - 1].tolist(), strict=True)], dtype=">u8")
    n = counts[long] - shingle + 1
    low = np.concatenate([[0], np.cumsum(n)])
    for a, b in slices((n * 64).tolist(), 8 << 20):
        bits = np.unpackbits(hashes[low[a] : low[b]].view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, low[a:b] - low[a], axis=0, dtype=np.int32)
        out[long[a:b]] = np.packbits(2 * sums > n[a:b, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint): the fingerprint's 64 bits as a signed number. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            docs_ = texts(batch.column(1))
            fp = [fingerprint_texts(docs_[a:b], shingle) for a, b in slices([len(d) for d in docs_])]
            fp = np.concatenate(fp).view(np.int64) if fp else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kept = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text"))
    return kept.mapInArrow(lean(run), f"`{id_col}` bigint, fp bigint")


def _links(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (larger, smallest linked) that join the fingerprints within the radius: those of a
    spanning forest, not all pairs. fp: those of one key, so that a chain may start."""
    n = len(fp)
    label = np.arange(n)
    xor = fp[:, None] ^ fp[None, :]
    part = [np.bitwise_count((xor >> np.uint64(48 - 16 * s)) & M16) for s in range(SEGMENTS)]
    ring = np.zeros((n, n), dtype=bool)
    for i in range(SEGMENTS):  # a chain of growing length whose sums stay within radius * l / 4
        total, held = np.zeros((n, n), dtype=np.uint8), np.ones((n, n), dtype=bool)
        for step in range(SEGMENTS):
            total = total + part[(i + step) % SEGMENTS]
            held &= total <= radius * (step + 1) // SEGMENTS
        ring |= held
    near = ring & (np.bitwise_count(xor) <= radius)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(n))
    return [(fp[leaf], fp[label[leaf]])] if len(leaf) else []


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, each once) within the radius: enough
    of them to connect all that any chain of links connects.

    Rows of one key are dealt over pairs of blocks of about ``block`` rows, so no task holds an
    unbounded key; a pair of blocks returns the links of a spanning forest.
    """
    if radius > RADIUS:
        raise ValueError("the ring of 4 segments of 16 bits is complete up to 3 bits")
    seg = [F.shiftrightunsigned("fp", 48 - 16 * s).bitwiseAND(F.lit(0xFFFF)) for s in range(SEGMENTS)]
    keys = []
    for i in range(SEGMENTS):
        after = seg[(i + 1) % SEGMENTS]
        for j, half in enumerate((F.shiftright(after, 8), after.bitwiseAND(F.lit(0xFF)))):
            keys.append(F.lit((2 * i + j) << 24).cast("bigint") + F.shiftleft(seg[i], 8) + half)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k"))
    full = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(full, "k").withColumn("m", blocks).withColumn("r", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("k", F.least("r", "j").alias("x"), F.greatest("r", "j").alias("y"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            edge = np.flatnonzero(np.any(rows_[1:, :3] != rows_[:-1, :3], axis=1)) + 1
            low, high = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows_)]])
            fp, out = rows_[:, 3].view(np.uint64), []
            two = low[high - low == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            out.append((a[near], b[near]))
            for x, y in zip(low, high, strict=True):
                if y - x > 2:
                    out += _links(fp[x:y], radius)
            return out

        def batch_of(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate([x[i] for x in links]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)]))
            rows_ = np.concatenate(held)
            last = np.flatnonzero(np.any(rows_[:, :3] != rows_[-1, :3], axis=1))
            done = last[-1] + 1 if len(last) else 0
            held = [rows_[done:]]
            if done:
                yield batch_of(found(np.ascontiguousarray(rows_[:done])))
        if held and len(held[0]):
            yield batch_of(found(np.ascontiguousarray(held[0])))

    dealt = rows.repartition(partitions(rows.sparkSession), "k", "x", "y").sortWithinPartitions("k", "x", "y")
    return dealt.mapInArrow(lean(run), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links, itself
    included. Rows with equal fingerprints are linked without being paired: only different
    fingerprints are searched. A null text counts as empty (fingerprint zero); a null id takes part
    under the smallest number and comes back null; equal ids stay separate rows; an empty table
    gives no rows; other columns are not read.
    """
    held = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(held, "id_", "text", shingle))
    own = prints.groupBy("fp").agg(F.min("id_").alias("least"))
    stars = components(link_fingerprints(own.select("fp"), radius))
    # label: one fingerprint for each set of linked ones; leaves and centre take the set's least id
    place = own.join(stars, own.fp == stars.v, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    root = place.groupBy("label").agg(F.min("least").alias("component_id"))
    named = place.join(root, "label").select("fp", "component_id")
    back = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    return prints.join(named, "fp").select(back("id_").alias(id_col), "fp", back("component_id").alias("component_id"))


def hex_print(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# --- documents of a given similarity ------------------------------------------------------------

CELLS_BITS, CELLS_PART = 20, 1 << 14
BUCKET_KEYS = 1 << 18
DENSE, MARKED = 2048, 256
FILTER_BITS = 1 << 22
FOLD = 4
FLUSH, PAIRS = 1 << 19, 1 << 20


def shingle_sets(docs: list[bytes], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word shingles in lower case (A-Z), ascending, text after
    text, and where each text's begin. Fewer words than a shingle: the whole sequence."""
    words = Words(docs, table=LOWER)
    one, counts = words.hashes(), words.counts()
    owner, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for length in range(1, shingle + 1):
        own = np.flatnonzero(counts == length) if length < shingle else np.flatnonzero(counts >= shingle)
        if not len(own):
            continue
        n = counts[own] - length + 1
        low = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(low[-1]) - np.repeat(low[:-1] - words.first[own], n)
        owner.append(np.repeat(own, n))
        hashes.append(mix(window_hashes(one, length)[at]))
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(docs) + 1))


def set_prints(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A number for each set of hashes (shingle_sets), equal for equal sets."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h + np.uint64(0x632BE59BD9B4E019)))])
    return mix(total[low[1:]] - total[low[:-1]] + np.diff(low).astype(np.uint64)).view(np.int64)


def ring_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: pairs of different sets (fp) whose texts' fingerprints (sim) are equal or, by the
    pigeonring, within the radius: enough of them to connect all that any chain of such pairs connects."""
    own = prints.select("sim", "fp").distinct()
    least = cut(own.groupBy("sim").agg(F.min("fp").alias("least")))
    links = link_fingerprints(least.select(F.col("sim").alias("fp")), radius)
    end = lambda name, value: least.select(F.col("sim").alias(name), F.col("least").alias(value))
    across = links.join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    equal = own.join(least, "sim").select(F.col("fp").alias("x"), F.col("least").alias("y"))
    return across.unionByName(equal).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed sets, one after the other, and the set of each hash."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), dtype="<u8"), np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])


def _gathered(rows: DataFrame, column: str, size: int, part_size: int, kind: str, count, join) -> np.ndarray:
    """An array of a fixed size, gathered from all rows: count(batch) gives a task's share of a batch,
    join(a, b) puts shares together. Parts of it are joined by different tasks."""

    def packed(part, cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], names=["part", "c"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=kind)
        for batch in parts(batches):
            total = join(total, count(batch.column(0)))
        cells = total.reshape(-1, part_size)
        used = np.flatnonzero(cells.any(axis=1))
        yield packed(used, cells[used])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, kind)
                held[part] = join(held[part], c) if part in held else c
        yield packed(list(held), list(held.values()))

    out = np.zeros(size, dtype=kind)
    each = rows.select(column).mapInArrow(lean(own), "part int, c binary").repartition(partitions(rows.sparkSession), "part")
    for r in each.mapInArrow(lean(joined), "part int, c binary").collect():  # the array's size
        out[r.part * part_size : (r.part + 1) * part_size] = np.frombuffer(r.c, kind)
    return out


def _cells(sets: DataFrame) -> np.ndarray:
    """How many hashes of the sets (column h) fall into each of 2**CELLS_BITS cells."""

    def count(column: pa.Array) -> np.ndarray:
        h, _ = _sets_of(column)
        return np.bincount((h >> np.uint64(64 - CELLS_BITS)).astype(np.int64), minlength=1 << CELLS_BITS)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.int64) + b, 0xFFFFFFFF).astype("<u4")

    return _gathered(sets, "h", 1 << CELLS_BITS, CELLS_PART, "<u4", count, add)


def _having(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets (fp first) that may be among the wanted ones (fp): a filter of FILTER_BITS bits, so
    that few of the others are moved."""

    def place(column: pa.Array) -> np.ndarray:
        return (column.to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)

    def mark(column: pa.Array) -> np.ndarray:
        out = np.zeros(FILTER_BITS, dtype=bool)
        out[place(column)] = True
        return np.packbits(out)

    bits = sets.sparkSession.sparkContext.broadcast(_gathered(wanted, "fp", FILTER_BITS // 8, FILTER_BITS // 64, "u1", mark, np.bitwise_or))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(held[place(batch.column(0))]))

    return sets.mapInArrow(lean(run), sets.schema)


def least_shared(size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """How many hashes two sets share at the least to resemble each other by ``similarity``."""
    return np.ceil((size_a + size_b) * (similarity / (1 + similarity)) - 1e-9)


def _fits(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets that share a key at these places may resemble each other enough. Their first
    common key says yes if they do."""
    return (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9) & (np.minimum(size_a - place_a, size_b - place_b) >= least_shared(size_a, size_b, similarity))


def _useful(rows: np.ndarray, similarity: float) -> np.ndarray:
    """The rows (key, set, size and place packed) whose set may resemble another one of its key.
    A key of over MARKED sets keeps all its rows."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])]
    key, size, place = np.ascontiguousarray(rows[:, 0]), rows[:, 2] >> 32, rows[:, 2] & 0xFFFFFFFF
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    many = np.diff(np.append(np.flatnonzero(new), len(key)))
    keep = np.repeat(many > MARKED, many)
    at = np.flatnonzero(~keep)
    for step in range(1, MARKED):
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (size[at] >= similarity * size[at + step] - 1e-9)]  # sizes ascend in a key
        if not len(at):
            break
        fits = at[_fits(size[at], place[at], size[at + step], place[at + step], similarity)]
        keep[fits] = True
        keep[fits + step] = True
    return rows[keep]


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)


def _folded(h: np.ndarray) -> np.ndarray:
    """64 * FOLD bits: each tells whether an odd number of the hashes fall on it. Two sets differ in as
    many hashes at least as their bits differ."""
    bit = mix(h + np.uint64(0xA24BAED4963EE407)) % np.uint64(64 * FOLD)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=64 * FOLD) & 1).astype(bool)).view(np.int64)


def _cross_pairs(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of sets with a common key and different labels that sizes, places and folded bits allow.
    rows: (key, set, size, place of the key in the set's order, label, folded bits)."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    key, v, size, place, label = np.ascontiguousarray(rows[:, :5].T)
    bits = np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
    at, held, n = np.arange(len(key)), [], 0
    for step in range(1, len(key)):
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (size[at] >= similarity * size[at + step] - 1e-9)]  # sizes ascend in a key
        if not len(at):
            break
        a = at[label[at] != label[at + step]]
        a = a[_fits(size[a], place[a], size[a + step], place[a + step], similarity)]
        apart = np.bitwise_count(bits[a] ^ bits[a + step]).sum(axis=1, dtype=np.int64)
        a = a[(size[a] + size[a + step] - apart) >= 2 * least_shared(size[a], size[a + step], similarity)]
        held.append(_distinct(v[a], v[a + step]))
        n += len(held[-1])
        if n > PAIRS:
            yield np.unique(np.concatenate(held), axis=0)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), axis=0)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The other columns of the rows of whole groups (sorted; the first ``keys`` columns tell them
    apart), many small groups at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]))
        if sum(map(len, held)) < FLUSH:
            continue
        rows = np.concatenate(held)
        other = np.flatnonzero(np.any(rows[:, :keys] != rows[-1, :keys], axis=1))
        done = other[-1] + 1 if len(other) else 0
        held = [rows[done:]]
        if done:
            yield rows[:done]
    if held and len(held[0]):
        yield np.concatenate(held)


def near_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, component_id) of every row: documents are linked whose sets of word shingles resemble
    each other by ``similarity`` or more; component_id is the smallest id reachable over links.

    First come the texts whose SimHash fingerprints the pigeonring finds within ``RADIUS`` bits
    (ring_pairs); such a pair is linked if its whole sets resemble each other enough. Fingerprints
    at a resemblance of ``similarity`` differ in more bits than the ring can search, so the sets that
    these links leave apart are searched by their hashes. No link between components is lost and no
    other is made (up to collisions of 64-bit hashes).

    In any order of all hashes, two sets of that resemblance share one of their first
    n - ceil(similarity * n) + 1 hashes, so these are the keys of a set; rare ones come first, by
    counts of hash cells. Keys that no two possible partners share go at once. Then every set is
    compared, whole, with two sets of each of its keys, picked by hashes: that joins a group of near
    copies without pairing it in full. Last, every pair with a common key that is not joined yet, and
    that sizes, places and folded bits allow, is compared likewise; a key that many sets of different
    components hold is dealt over pairs of blocks. Equal sets are linked without being paired. Texts
    without words are linked with each other only. Null texts, null, equal and clashing columns as in
    near_duplicates.
    """
    spark = docs.sparkSession
    held = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.col(text_col).alias("text"))

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            docs_ = texts(batch.column(1))
            for a, b in slices([len(d) for d in docs_]):
                h, low = shingle_sets(docs_[a:b], shingle)
                fp = set_prints(h, low)
                packed = [h[x:y].tobytes() for x, y in zip(low[:-1], low[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp), pa.array(packed, pa.binary())], names=["id_", "fp", "h"])

    def both_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            docs_ = texts(batch.column(1))
            for a, b in slices([len(d) for d in docs_]):
                fp = set_prints(*shingle_sets(docs_[a:b], shingle))
                sim = fingerprint_texts(docs_[a:b]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp), pa.array(sim)], names=["id_", "fp", "sim"])

    prints = cut(held.mapInArrow(lean(both_prints), "id_ bigint, fp bigint, sim bigint"))
    near = cut(ring_pairs(prints))
    sets = held.mapInArrow(lean(prints_of), "id_ bigint, fp bigint, h binary")  # made anew where needed: cheaper than to keep
    counts = _cells(sets)
    cells = spark.sparkContext.broadcast(counts)
    bits = min(30, max(8, int(counts.sum(dtype=np.int64) * (1 - similarity) / BUCKET_KEYS).bit_length()))

    def keys_in(fp: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(key, set, size, place) of the keys of some sets, and the number of each key's set."""
        h, owner = _sets_of(column)
        order = np.lexsort((mix(h), cells.value[(h >> np.uint64(64 - CELLS_BITS)).astype(np.int64)], owner))
        size = np.bincount(owner, minlength=len(fp))
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        first = place < (size - np.ceil(similarity * size - 1e-9) + 1)[owner]
        h, owner, place = h[order[first]], owner[first], place[first]
        return np.column_stack([h.view(np.int64), fp[owner], size[owner], place]), owner

    def bucket_of_key(key: np.ndarray) -> np.ndarray:
        return (mix(np.ascontiguousarray(key).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def packed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, x): the keys of different sets, (key, set, size and place) packed by bucket."""
        waiting, n = [], 0

        def out() -> pa.RecordBatch:
            rows = np.unique(np.concatenate(waiting), axis=0)
            bucket = bucket_of_key(rows[:, 0])
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["bucket", "x"])

        for batch in parts(batches):
            fp, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            rows = keys_in(fp, batch.column(1).take(pa.array(once)))[0]
            waiting.append(np.column_stack([rows[:, :2], rows[:, 2] << 32 | rows[:, 3]]))
            n += len(rows)
            if n > FLUSH:
                yield out()
                waiting, n = [], 0
        if n:
            yield out()

    def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's rows of keys that possible partners share."""
        now, rows, n, crowded = None, [], 0, False

        def out(whole: bool) -> pa.RecordBatch:
            x = np.concatenate(rows)
            x = _useful(x, similarity) if whole else x
            cols = (x[:, 0], x[:, 1], x[:, 2] >> 32, x[:, 2] & 0xFFFFFFFF)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["k", "fp", "size", "place"])

        for batch in batches:
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and rows:
                    yield out(not crowded)
                    rows, n, crowded = [], 0, False
                now = bucket
                rows.append(np.frombuffer(x, "<i8").reshape(-1, 3))
                n += len(rows[-1])
                if n > 4 * FLUSH:  # a key that very many sets hold: its bucket goes on unsifted
                    yield out(False)
                    rows, n, crowded = [], 0, True
        if rows:
            yield out(not crowded)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = [_folded(np.frombuffer(h, "<u8")) for h in batch.column(1).to_pylist()]
            x = np.stack(x) if x else np.zeros((0, FOLD), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["fp", *(f"b{k}" for k in range(FOLD))])

    def cross_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            new = np.concatenate([[True], np.any(rows[1:, :3] != rows[:-1, :3], axis=1)])
            rows = rows[:, 2:]
            rows[:, 0] = np.cumsum(new)
            for ab in _cross_pairs(rows, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                least, both = min(len(x), len(y)) // 8, 0
                if least >= similarity * max(len(x), len(y)) / 8 - 1e-9:
                    both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(both >= similarity * ((len(x) + len(y)) // 8 - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets resemble each other enough."""
        both = pairs.join(whole.select(F.col("fp").alias("a"), F.col("h").alias("x")), "a").join(whole.select(F.col("fp").alias("b"), F.col("h").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lean(alike), "a bigint, b bigint")

    def apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
        """The pairs that the stars do not join."""
        for c in "ab":
            pairs = pairs.join(stars.select(F.col("v").alias(c), F.col("label").alias(f"of_{c}")), c, "left")
        return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    dealt = sets.select("fp", "h").mapInArrow(lean(packed_keys), "bucket int, x binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    rows = cut(dealt.mapInArrow(lean(shared_keys), "k bigint, fp bigint, size bigint, place bigint"))
    touched = rows.select("fp").distinct()
    whole = cut(_having(sets.select("fp", "h"), touched).join(touched, "fp", "left_semi").groupBy("fp").agg(F.first("h").alias("h")))

    # a set that no possible partner shares a key with is in no link, so the check needs the others only
    links = cut(checked(near))
    stars = components(links)

    # two sets of each key and class of sizes, and of the class below: partners lie in neighbouring classes
    graded = rows.withColumn("step", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(float(-np.log(similarity) * (1 + 1e-9)))))
    picked = F.array(*[F.min(F.struct(F.xxhash64(F.lit(turn), "fp").alias("o"), F.col("fp").alias("other"), F.col("size").alias("s2"), F.col("place").alias("p2"))) for turn in (0, 1)])
    picked = graded.groupBy("k", "step").agg(picked.alias("x"))
    picked = picked.select("k", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"), "x").select("k", "step", F.inline("x")).drop("o").distinct()
    fits = (F.least("size", "s2") >= similarity * F.greatest("size", "s2") - 1e-9) & (F.least(F.col("size") - F.col("place"), F.col("s2") - F.col("p2")) >= F.ceil((F.col("size") + F.col("s2")) * (similarity / (1 + similarity)) - 1e-9))
    pairs = cut(graded.join(picked, ["k", "step"]).where((F.col("fp") != F.col("other")) & fits).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct())
    links = links.unionByName(cut(checked(apart(pairs, stars))))
    stars = components(links)

    labelled = whole.mapInArrow(lean(folded), "fp bigint, " + ", ".join(f"b{k} bigint" for k in range(FOLD))).join(stars.select(F.col("v").alias("fp"), "label"), "fp", "left")
    rows = cut(rows.join(labelled.withColumn("label", F.coalesce("label", "fp")), "fp"))
    mixed = rows.groupBy("k").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n")).where("l <> m").select("k", F.ceil(F.col("n") / DENSE).cast("int").alias("m"))
    rows = rows.join(mixed, "k").withColumn("r", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("k", F.least("r", "j").alias("i"), F.greatest("r", "j").alias("j"), "fp", "size", "place", "label", *(f"b{k}" for k in range(FOLD)))
    rows = rows.repartition(partitions(spark), "k", "i", "j").sortWithinPartitions("k", "i", "j")
    more = checked(cut(rows.mapInArrow(lean(cross_of), "a bigint, b bigint").distinct()))
    stars = components(links.unionByName(more))
    own = prints.groupBy("fp").agg(F.min("id_").alias("least"))
    place = own.join(stars, own.fp == stars.v, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    root = place.groupBy("label").agg(F.min("least").alias("component_id"))
    named = place.join(root, "label").select("fp", "component_id")
    back = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    return prints.join(named, "fp").select(back("id_").alias(id_col), back("component_id").alias("component_id"))


def without_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id. Rows that
    share an id are one document; those with a null id stay."""
    found, name = near_copies(docs, similarity, id_col, text_col), fresh(docs.columns, "gone")
    gone = found.where(F.col(id_col) != F.coalesce(F.col("component_id"), F.lit(NO_ID))).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == F.col(name), "left_anti")
