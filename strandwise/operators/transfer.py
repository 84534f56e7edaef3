"""Features carried through edit logs.

A feature's ends are two places between bases that edits push along: text put in at or before its start
moves the start, text put in before its end moves the end, and what is taken out draws both to the cut.
Each is a rising step function of the place, so a log becomes one sorted table of stretches, made by a
block of edits at a time, and all features of the document are looked up in it together, however many
edits there are. How much went from either end comes with it, for the reading frame.

Edits and features come in one stream, sorted by document, edits first: one shuffle, and the state of
one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
MOVED = "feature_id, start, end, frame, cut_start, cut_end, length"


class Places:
    """Where places 0..n of a text are after some edits: stretches that begin at ``low``, each with the
    new place of its first (``to``), whether the others follow it one by one or stand still (``slope``),
    and the bases lost beside the first place (``lost``, changing by ``turn`` from place to place).

    start: places that text put in at them moves, and that lose what is behind them; else places that
    stay, and lose what is before them. On a circle a start that is drawn to the text's end goes on at
    the origin, an end that is drawn to the origin is the text's end; ``rounds`` counts both."""

    def __init__(self, start: bool, circular: bool):
        self.start, self.circular = start, circular
        self.low, self.to, self.slope, self.lost, self.turn, self.rounds = (np.array([x]) for x in (0, 0, 1, 0, 0, 0))

    def _split(self, at: int) -> None:
        """Divides the stretch that moves through the new place ``at``, so that one begins there."""
        k = np.flatnonzero((self.slope == 1) & (self.to < at) & (at < self.to + np.append(np.diff(self.low), 1 << 60)))
        for x in k[::-1].tolist():
            step = at - int(self.to[x])
            for name, value in (("low", self.low[x] + step), ("to", at), ("slope", 1), ("lost", self.lost[x] + step * self.turn[x]), ("turn", self.turn[x]), ("rounds", self.rounds[x])):
                setattr(self, name, np.insert(getattr(self, name), x + 1, value))

    def insert(self, at: int, size: int) -> None:
        self._split(at + (not self.start))
        behind = self.to >= at if self.start else self.to > at
        self.to = np.where(behind, self.to + size, self.to)

    def delete(self, a: int, b: int, length: int) -> None:
        """Takes out a:b; length: of the text that is left."""
        if self.start:
            self._split(a)
            self._split(b)
            inside = (self.to >= a) & (self.to < b)
            self.lost = np.where(inside, self.lost + b - self.to, self.lost)
            self.turn = np.where(inside & (self.slope == 1), self.turn - 1, self.turn)
        else:
            self._split(a + 1)
            self._split(b + 1)
            inside = (self.to > a) & (self.to <= b)
            self.lost = np.where(inside, self.lost + self.to - a, self.lost)
            self.turn = np.where(inside & (self.slope == 1), self.turn + 1, self.turn)
        behind = ~inside & (self.to >= b)
        self.to = np.where(inside, a, np.where(behind, self.to - (b - a), self.to))
        self.slope = np.where(inside, 0, self.slope)
        if self.circular and length:
            over = (self.slope == 0) & (self.to == (length if self.start else 0))
            self.to = np.where(over, 0 if self.start else length, self.to)
            self.rounds = self.rounds + np.where(over, 1 if self.start else -1, 0)

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.searchsorted(self.low, place, side="right") - 1
        step = place - self.low[k]
        return self.to[k] + step * self.slope[k], self.lost[k] + step * self.turn[k], self.rounds[k]


class Log:
    """A document's edits as tables of places, ``BLOCK`` edits each, and its length by now."""

    def __init__(self, length: int):
        self.length, self.blocks, self.n = length, [], BLOCK

    def add(self, op: str | None, at: int | None, size: int | None, put: int | None, circular: bool) -> None:
        """An insertion of ``size`` at a place, a deletion of ``size`` from it on, or a replacement of
        ``size`` by ``put``. Places and sizes are clipped to the text; on a circle a deletion may pass
        the origin. Other operations and nulls change nothing."""
        if op not in ("insert", "delete", "replace") or at is None or size is None or size < 0:
            return
        if self.n == BLOCK:
            self.blocks.append((Places(True, circular), Places(False, circular)))
            self.n = 0
        self.n += 1
        at = min(max(at, 0), self.length)
        end = at if op == "insert" else min(at + size, self.length)
        over = min(at + size - self.length, at) if circular and op == "delete" and at + size > self.length else 0
        left = self.length - (end - at)
        put = size if op == "insert" else (put or 0) if op == "replace" else 0
        one, two = self.blocks[-1]
        if end > at:
            one.delete(at, end, left)
        if over:  # starts go on behind the origin, ends come back from it
            one.delete(0, over, left - over)
            two.delete(0, over, self.length - over)
        if end > at:
            two.delete(at - over, end - over, left - over)
        if put:
            one.insert(at, put)
            two.insert(at, put)
        self.length = left - over + put

    def moved(self, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """New starts and ends, the bases lost at either, and the turns made by either."""
        found = [start, np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)], [end, np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)]
        for block in self.blocks:
            for held, side in zip(found, block, strict=True):
                held[0], gone, rounds = side.at(held[0])
                held[1], held[2] = held[1] + gone, held[2] + rounds
        return found


def moved_features(features: DataFrame, edits: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and MOVED: the features (feature_id, doc_id, strand, start, end, frame) of documents (doc_id,
    topology, length) after all edits (doc_id, ms, event_id, op, position, len, put).

    Features that have lost all their bases are left out. frame, the base within the feature at which
    its first codon starts, counted from 0 on its own strand, goes with what is lost at that end. A
    circle's feature may pass the origin: its end is then past the length. Features without a document,
    and with a null or empty range, are left out."""
    e = edits.select("doc_id", F.lit(1).alias("kind"), "ms", "event_id", "op", F.col("position").cast("bigint").alias("a"), F.col("len").cast("bigint").alias("b"), F.col("put").cast("bigint").alias("c"))
    d = documents.select("doc_id", F.lit(0).alias("kind"), F.lit(None).cast(dict(e.dtypes)["ms"]).alias("ms"), F.lit(None).cast(dict(e.dtypes)["event_id"]).alias("event_id"), F.col("topology").alias("op"), F.col("length").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"))
    kind = dict(features.dtypes)["feature_id"]
    own = features.where("start IS NOT NULL AND end > start AND start >= 0").select("doc_id", F.lit(2).alias("kind"), F.lit(None).cast(dict(e.dtypes)["ms"]).alias("ms"), F.lit(None).cast(dict(e.dtypes)["event_id"]).alias("event_id"), F.col("strand").alias("op"), F.col("start").cast("bigint").alias("a"), F.col("end").cast("bigint").alias("b"), F.coalesce(F.col("frame").cast("bigint"), F.lit(0)).alias("c"), "feature_id")
    rows = own.unionByName(e.withColumn("feature_id", F.lit(None).cast(kind))).unionByName(d.withColumn("feature_id", F.lit(None).cast(kind)))
    rows = rows.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "kind", "ms", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, log, circular, before = object(), None, False, 0
        for batch in batches:
            docs, kinds, _, _, ops, a, b, c, ids = (x.to_pylist() for x in batch.columns)
            out = [[] for _ in range(8)]
            k = 0
            while k < len(docs):
                if docs[k] != doc:
                    doc, log = docs[k], None
                if kinds[k] == 0:
                    log, circular, before = Log(a[k] or 0), ops[k] == "circular", a[k] or 0
                elif kinds[k] == 1 and log is not None:
                    log.add(ops[k], a[k], b[k], c[k], circular)
                elif kinds[k] == 2:
                    high = k
                    while high < len(docs) and docs[high] == doc and kinds[high] == 2:
                        high += 1
                    if log is not None:
                        for column, values in zip(out, _of(log, before, circular, doc, ops[k:high], a[k:high], b[k:high], c[k:high], ids[k:high]), strict=True):
                            column.extend(values)
                    k = high
                    continue
                k += 1
            if out[0]:
                types = [batch.schema.field(0).type, batch.schema.field(8).type, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", *MOVED.split(", ")])

    return rows.mapInArrow(run, f"doc_id {dict(features.dtypes)['doc_id']}, feature_id {kind}, start bigint, end bigint, frame int, cut_start boolean, cut_end boolean, length bigint")


def _of(log: Log, before: int, circular: bool, doc, strands: list, a: list, b: list, c: list, ids: list) -> list[list]:
    start, end, frame = (np.array(x, dtype=np.int64) for x in (a, b, c))
    wraps = end > before
    good = (start < before) & (~wraps | (circular & (end <= before + start)))
    (s, left, on), (e, right, back) = log.moved(np.where(good, start, 0), np.where(good, np.where(wraps, end - before, end), 0))
    n = log.length
    e = s + (e + (back + wraps) * n) - (s + on * n)
    keep = np.flatnonzero(good & (e > s))
    turned = np.array([x == "reverse" for x in strands])
    frame = (frame - np.where(turned, right, left)) % 3
    return [[doc] * len(keep), [ids[k] for k in keep], s[keep].tolist(), e[keep].tolist(), frame[keep].tolist(), (left > 0)[keep].tolist(), (right > 0)[keep].tolist(), [n] * len(keep)]
