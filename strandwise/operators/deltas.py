"""Histories of texts as chains of deltas with whole texts in between.

A version is kept as what it shares with the one before (lengths of the common start and end) and the
letters in the middle; every ``EVERY``-th version, and one whose middle is over half of it, is kept
whole. So a chain has a bounded length, and any version is read back from the last whole text before it.
Versions of a document come sorted in one stream: a delta needs its predecessor only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVERY = 16
DELTA = "version bigint, whole boolean, prefix int, suffix int, middle string"


def shared_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common start and of the common end behind it."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common start by halving: slices compare at memory speed
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    prefix, low, high = low, 0, min(len(a), len(b)) - low
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    return prefix, low


def encode(versions: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id and DELTA of versions (doc_id, version, text): the versions of a document by number.

    Rows that share a document and version count as one, with the least text; a null text is empty;
    null documents and versions are left out."""
    held = versions.where("doc_id IS NOT NULL AND version IS NOT NULL").groupBy("doc_id", F.col("version").cast("bigint").alias("version")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    rows = held.repartition("doc_id").sortWithinPartitions("doc_id", "version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, before, since = object(), "", 0
        for batch in batches:
            out: list[tuple] = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                prefix, suffix = shared_ends(before, text) if d == doc else (0, 0)
                whole = d != doc or since + 1 >= every or 2 * (len(text) - prefix - suffix) > len(text)
                since = 0 if whole else since + 1
                out.append((True, 0, 0, text) if whole else (False, prefix, suffix, text[prefix : len(text) - suffix]))
                doc, before = d, text
            kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "version", "whole", "prefix", "suffix", "middle"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {DELTA}")


def decode(deltas: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, version, text of all versions, or of the ``wanted`` (doc_id, version) alone: then only the
    rows from a version's last whole text on are read back. Damaged chains, which begin without a whole
    text or share more than there is, give a null text."""
    rows = deltas
    if wanted is not None:
        ask = wanted.where("doc_id IS NOT NULL AND version IS NOT NULL").select("doc_id", F.col("version").cast("bigint").alias("version"), F.lit(True).alias("asked")).distinct()
        rows = deltas.join(ask, ["doc_id", "version"], "left")
    else:
        rows = deltas.withColumn("asked", F.lit(True))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "version").select("doc_id", "version", "asked", "whole", "prefix", "suffix", "middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, text, chain = object(), None, []
        for batch in batches:
            at, out = [], []
            for k, (d, _, asked, whole, prefix, suffix, middle) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if d != doc:
                    doc, text, chain = d, None, []
                if whole:
                    text, chain = middle or "", []
                else:
                    chain.append((prefix, suffix, middle))
                if asked:
                    for p, s, m in chain:  # a version nobody asked for is only passed through here
                        fits = text is not None and p is not None and s is not None and min(p, s) >= 0 and p + s <= len(text)
                        text = text[:p] + (m or "") + text[len(text) - s :] if fits else None
                    chain = []
                    at.append(k)
                    out.append(text)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(out, pa.string())], names=["doc_id", "version", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, version bigint, text string")


def chain_lengths(deltas: DataFrame) -> DataFrame:
    """doc_id, versions, whole, longest: how many versions of each document are kept, how many of them
    whole, and the most deltas that any version needs."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("version")
    chains = deltas.withColumn("chain", F.sum(F.col("whole").cast("int")).over(w))
    per = chains.groupBy("doc_id", "chain").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("versions"), F.count("*").alias("whole"), (F.max("n") - 1).alias("longest"))


