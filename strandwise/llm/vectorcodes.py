"""Product codes of vectors by exact integer k-means with the exponion search.

Components become integers; vectors are cut into equal parts with a codebook each. A part's nearest
entry is searched from the entry it had before: with ``u`` its distance to that entry, an entry that
is as near lies within ``2 u`` of it, so only that stretch of the entry's neighbours, sorted by their
distance from it, is scanned. All distances are integers and ties go to the lower index, so the
result is that of a full scan. Numbers that might leave 64 bits are computed as Python integers.

Vectors stay where they are: each round is one pass in which a task codes its rows and adds up the
parts of each entry. Only those sums are shuffled, a row per task and entry, and only the codebooks
(entries x dimensions integers) reach the driver and are sent back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.cluster import cut
from strandwise.llm.text import lean, parts

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
ROWS = 8192
LIMB = 30
#: Components below this leave differences, squares and four times their sums within 64 bits.
SAFE = 1 << 24


def to_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where all are below SAFE, else as Python integers."""
    scaled = np.asarray(values, dtype=np.float64)
    if not scaled.size or np.abs(scaled).max() < SAFE / scale - 1:
        return np.floor(scaled * scale).astype(np.int64)
    whole = np.empty(scaled.size, dtype=object)
    for k, x in enumerate(scaled.ravel().tolist()):
        a, b = x.as_integer_ratio()
        whole[k] = a * scale // b
    return whole.reshape(scaled.shape)


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x and its squared distance, ties to the lower index, searched
    from the entries ``start``."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, order, axis=1)
    best = start.copy()
    least = ((x - book[start]) ** 2).sum(axis=1)
    reach = np.zeros(len(x), dtype=np.int64)  # how many neighbours lie within twice the distance
    for entry in np.unique(start):
        own = np.flatnonzero(start == entry)
        reach[own] = np.searchsorted(gaps[entry], 4 * least[own], side="right")
    live = np.arange(len(x))
    for rank in range(len(book)):
        live = live[reach[live] > rank]
        if not len(live):
            break
        other = order[start[live], rank]
        far = ((x[live] - book[other]) ** 2).sum(axis=1)
        better = (far < least[live]) | ((far == least[live]) & (other < best[live]))
        better = better.astype(bool)
        best[live[better]], least[live[better]] = other[better], far[better]
    return best, least


def _guess(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries to start from where there is no previous one: those with the nearest sum of components."""
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    at = np.searchsorted(sums[order], x.sum(axis=1))
    return order[np.minimum(at, len(book) - 1)]


def _limbs(values: list[int]) -> list[int]:
    """The integers as limbs of ``LIMB`` bits, all with as many; the last has the sign."""
    n = max([v.bit_length() for v in values] + [0]) // LIMB + 1
    return [(v >> LIMB * k) & ((1 << LIMB) - 1) if k < n - 1 else v >> LIMB * k for v in values for k in range(n)]


class Codebooks:
    """parts x entries x width integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def assign(self, x: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) of the vectors x and the summed squared distances."""
        p, _, width = self.entries.shape
        out, error = np.zeros((len(x), p), dtype=np.int64), np.zeros(len(x), dtype=object if object in (x.dtype, self.entries.dtype) else np.int64)
        for k in range(p):
            own, book = x[:, k * width : (k + 1) * width], self.entries[k]
            out[:, k], far = nearest(own, book, _guess(own, book) if codes is None else codes[:, k])
            error = error + far
        return out, error

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries replaced by the floored means of their parts (count, component sums)."""
        new = self.entries.astype(object)
        for (part, entry), (n, total) in sums.items():
            new[part, entry] = [t // n for t in total]
        return Codebooks(_narrow(new))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if all(abs(v) < SAFE for v in x.ravel().tolist()) else x


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return to_integers(flat.reshape(len(column), -1), scale)


def _step(rows: DataFrame, books: Codebooks, scale: int, coded: bool) -> DataFrame:
    """Codes every row (from its codes so far, if coded) and appends rows that hold, for each part and
    entry of the task, the count and the component sums: slot, limbs (count first)."""
    p, entries, width = books.entries.shape
    held = rows.sparkSession.sparkContext.broadcast(books)
    place = {c: k for k, c in enumerate(rows.columns)}
    kept = [f for f in rows.schema.fields if f.name not in ("codes_", "slot_", "limbs_")]
    schema = T.StructType([*kept, T.StructField("codes_", T.BinaryType()), T.StructField("slot_", T.IntegerType()), T.StructField("limbs_", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(p * entries, dtype=np.int64)
        total = np.zeros((p * entries, width), dtype=object)
        types = None
        for batch in parts(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(place["vec_"]), scale)
            codes = np.frombuffer(b"".join(batch.column(place["codes_"]).to_pylist()), dtype=np.uint8).reshape(len(x), p).astype(np.int64) if coded else None
            codes, _ = held.value.assign(x, codes)
            for k in range(p):
                slot = k * entries + codes[:, k]
                count += np.bincount(slot, minlength=p * entries)
                part = np.zeros((p * entries, width), dtype=x.dtype)
                np.add.at(part, slot, x[:, k * width : (k + 1) * width])
                total += part
            n = batch.num_rows
            cols = [batch.column(place[f.name]) for f in kept]
            types = [c.type for c in cols]
            packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, packed, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=schema.names)
        if types is not None:
            used = np.flatnonzero(count)
            limbs = [_limbs([int(count[s]), *map(int, total[s])]) for s in used]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), t) for t in types), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(limbs, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def _sums(stepped: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of every used entry: as many rows as the codebooks have numbers."""
    _, entries, width = books.entries.shape
    limbs = stepped.where("slot_ IS NOT NULL").select("slot_", (F.size("limbs_") / (width + 1)).cast("int").alias("n"), F.posexplode("limbs_"))
    added = limbs.groupBy("slot_", (F.col("pos") / F.col("n")).cast("int").alias("value"), (F.col("pos") % F.col("n")).alias("limb")).agg(F.sum("col").alias("s"))
    found: dict[int, list[int]] = {}
    for r in added.collect():
        found.setdefault(r.slot_, [0] * (width + 1))[r.value] += r.s << LIMB * r.limb
    return {divmod(slot, entries): (v[0], v[1:]) for slot, v in found.items()}


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Left out are vectors that are null or empty, hold null or non-finite components or have another
    length than the one with the smallest id; that length must be a multiple of n_parts. The first
    codebooks are the parts of the ``entries`` vectors with the smallest ids (of equal ids the
    smallest vectors, null ids last; all vectors if there are fewer). Rows that share an id stay rows
    of their own. Equal labels, null among them, share a label_error. Errors beyond 64 bits are null.
    An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so there are 256 entries at most")
    spark = vectors.sparkSession
    finite = F.forall("vec_", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    held = vectors.select(F.col(id_col).cast("bigint").alias("id_"), F.col(vector_col).alias("vec_"), F.col(label_col).alias("label_"))
    held = held.where(F.col("vec_").isNotNull() & (F.size("vec_") > 0) & finite)
    first = held.orderBy(F.col("id_").asc_nulls_last(), F.col("vec_").asc()).limit(1).select(F.size("vec_").alias("n")).head()
    size = first.n if first else n_parts
    if size % n_parts:
        raise ValueError(f"vectors of {size} components can't be cut into {n_parts} equal parts")
    held = held.where(F.size("vec_") == size)
    seeds = [r.vec_ for r in held.orderBy(F.col("id_").asc_nulls_last(), F.col("vec_").asc()).limit(entries).select("vec_").collect()]
    width = size // n_parts
    start = to_integers(np.array(seeds, dtype=np.float64).reshape(len(seeds), size), scale)
    books = Codebooks(start.reshape(len(seeds), n_parts, width).transpose(1, 0, 2)) if seeds else Codebooks(np.zeros((n_parts, 1, width), dtype=np.int64))
    rows = held
    for k in range(rounds):
        stepped = cut(_step(rows, books, scale, k > 0))
        books = books.moved(_sums(stepped, books))
        rows = stepped.where("slot_ IS NULL").drop("slot_", "limbs_")
    final = cut(_coded(rows, books, scale, rounds > 0))
    by_label = final.groupBy("label_").agg(F.when(F.count("error_") == F.count("*"), _long(F.sum("error_"))).alias("label_error"))
    joined = final.alias("v").join(by_label.alias("l"), F.col("v.label_").eqNullSafe(F.col("l.label_")))
    return joined.select(F.col("v.id_").alias(id_col), F.col("v.code").alias("code"), _long(F.col("v.error_")).alias("error"), F.col("l.label_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def _long(x):
    return x.try_cast("bigint")


def _coded(rows: DataFrame, books: Codebooks, scale: int, coded: bool) -> DataFrame:
    """(id_, label_, code, error_) under the final codebooks; an error beyond 38 digits is null."""
    p = len(books.entries)
    held = rows.sparkSession.sparkContext.broadcast(books)
    place = {c: k for k, c in enumerate(rows.columns)}
    schema = T.StructType([T.StructField("id_", T.LongType()), rows.schema["label_"], T.StructField("code", T.StringType()), T.StructField("error_", T.DecimalType(28, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.decimal128(28, 0)
        for batch in parts(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(place["vec_"]), scale)
            codes = np.frombuffer(b"".join(batch.column(place["codes_"]).to_pylist()), dtype=np.uint8).reshape(len(x), p).astype(np.int64) if coded else None
            codes, error = held.value.assign(x, codes)
            code = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            errors = pa.array([Decimal(e) if e < 10**28 else None for e in map(int, error)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(place["id_"]), batch.column(place["label_"]), code, errors], names=schema.names)

    return rows.mapInArrow(lean(run), schema)
