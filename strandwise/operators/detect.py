"""Parts of a library found in molecules with few mismatches, and the hits that are kept.

With m mismatches at most, one of m + 1 pieces of a part is found unchanged: a seed from each piece is
looked up in every place of the molecules. Which seeds exist is one bit each of 4 ** SEED, so only
places that start a seed become rows; an equi-join on seeds gives candidates, which are compared
letter by letter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.seq import revcomp
from strandwise.operators.scan import MASKS, Laid, codes, mapped, packed

SEED = 10


def seeded_hits(mol: DataFrame, parts: DataFrame, mismatches: int = 3) -> DataFrame:
    """seq_id, part_id, strand, start, end, mismatches: where a part (part_id, sequence) or its reverse
    complement stands in a molecule (seq_id, topology, length, sequence); on circles across the origin
    too, end then passes the length. Parts of under (mismatches + 1) * SEED bases, longer than the
    molecule, or with ambiguous bases in a seed are found by their other seeds or not at all; ambiguous
    bases of a molecule count as mismatches."""
    both = F.array(F.struct(F.lit("forward").alias("strand"), F.upper("sequence").alias("text")), F.struct(F.lit("reverse").alias("strand"), revcomp(F.upper("sequence")).alias("text")))
    p = parts.select("part_id", F.inline(both)).withColumn("n", F.length("text")).where(F.col("n") >= (mismatches + 1) * SEED)
    offset = lambda k: F.floor(F.lit(k) * F.col("n") / (mismatches + 1)).cast("int")
    seeds = p.select("*", F.inline(F.array(*[F.struct(offset(k).alias("offset"), F.expr("substring(text, {} + 1, {})".format(f"floor({k} * n / {mismatches + 1})", SEED)).alias("seed")) for k in range(mismatches + 1)])))
    seeds = seeds.where(F.col("seed").rlike(f"^[ACGT]{{{SEED}}}$")).withColumn("key", packed(F.col("seed")))
    wanted = np.zeros(4**SEED, dtype=bool)
    wanted[[r.key for r in seeds.select("key").distinct().collect()]] = True  # 4 ** SEED rows at most
    held = mol.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def found(piece: Laid):
        number, plain = codes(MASKS[piece.buf], SEED)
        at = np.flatnonzero(np.unpackbits(held.value).astype(bool)[number] & plain)
        good, rows, pos = piece.places(at, SEED)
        yield rows, number[at[good]], pos

    places = mapped(mol.select("seq_id", "sequence", "topology"), ["seq_id"], SEED - 1, "key bigint, pos bigint", found)
    cand = places.join(seeds.select("key", "part_id", "strand", "text", "n", "offset"), "key").select("seq_id", "part_id", "strand", "text", "n", (F.col("pos") - F.col("offset")).alias("low"))
    cand = cand.join(mol.select("seq_id", "topology", "length", F.upper("sequence").alias("sequence")), "seq_id")
    circle = F.col("topology") == "circular"
    cand = cand.withColumn("start", F.when(circle, F.pmod("low", F.col("length"))).otherwise(F.col("low"))).where((F.col("n") <= F.col("length")) & (circle | ((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("length")))))
    window = F.substring(F.when(circle, F.concat("sequence", "sequence")).otherwise(F.col("sequence")), (F.col("start") + 1).cast("int"), F.col("n"))
    cand = cand.select("seq_id", "part_id", "strand", "start", "n", "text", window.alias("window")).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, windows = (batch.column(k).cast(pa.binary()).to_pylist() for k in (5, 6))
            apart = np.array([np.count_nonzero(np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)) for a, b in zip(texts, windows, strict=True)], dtype=np.int32)
            keep = pa.array(apart <= mismatches)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in range(5)), pa.array(apart).filter(keep)], names=["seq_id", "part_id", "strand", "start", "n", "mismatches"])

    kinds = dict(cand.dtypes)
    hits = cand.mapInArrow(compare, f"seq_id {kinds['seq_id']}, part_id {kinds['part_id']}, strand string, start bigint, n int, mismatches int")
    return hits.select("seq_id", "part_id", "strand", "start", (F.col("start") + F.col("n")).alias("end"), "mismatches")


def _kept(rows: list[tuple], share: float) -> list[int]:
    """The rows (size, matched, forward first, part, type, start, end, strand, length) that stay: taken from the
    largest on, those that share ``share`` of themselves with a kept one of their type go if that one
    matches no worse; on the other strand only if they cover the same bases."""
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][0], -rows[k][1], rows[k][2], rows[k][3], rows[k][5]))
    kept: list[int] = []
    for k in order:
        size, matched, _, _, kind, start, end, strand, length = rows[k]
        for o in kept:
            s2, m2, _, _, kind2, start2, end2, strand2, _ = rows[o]
            common = max(max(0, min(end, end2 + t) - max(start, start2 + t)) for t in (-length, 0, length))
            same = (start - start2) % length == 0 and size == s2
            if kind == kind2 and common >= share * size and m2 / s2 >= matched / size and (strand == strand2 or same):
                break
        else:
            kept.append(k)
    return kept


def keep_best(hits: DataFrame, share: float = 0.9) -> DataFrame:
    """The hits (seq_id, part_id, type, length, strand, start, end, mismatches) that no better one of
    their molecule covers; greedy, so one molecule's hits are looked at together."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        size = f["end"] - f["start"]
        rows = list(zip(size, size - f["mismatches"], f["strand"] != "forward", f["part_id"], f["type"], f["start"], f["end"], f["strand"], f["length"], strict=True))
        return f.iloc[sorted(_kept(rows, share))]

    return hits.groupBy("seq_id").applyInPandas(run, hits.schema)
