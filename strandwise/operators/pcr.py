"""Products of amplification as molecules: primers with their tails, and what lies between.

A product carries its primers' own bases, tails included, where they pair, and the template's between
them. Molecules and products come in one stream sorted by molecule, so a template is moved once and
only one is held, however many products it has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise import dims


def product_text(template: str, circular: bool, start: int, size: int, forward: str, reverse: str, tails: tuple[str, str] = ("", "")) -> str | None:
    """The top strand of a product of ``size`` template bases from ``start`` on; primers that overlap are
    written once, the forward one first. None if the template doesn't reach so far."""
    turned = dims.revcomp(reverse)
    low, high = start + len(forward), start + size - len(reverse)
    if size < max(len(forward), len(reverse)) or start < 0 or (start + size > len(template) and not (circular and size <= len(template) and start < len(template))):
        return None
    between = (template + template if start + size > len(template) else template)[low:high] if high >= low else ""
    return tails[0] + forward + between + turned[max(0, low - high) :] + dims.revcomp(tails[1])


def product_texts(products: DataFrame, mol: DataFrame, primers: DataFrame) -> DataFrame:
    """seq_id, forward_id, reverse_id, start, size, sequence: products (seq_id, forward_id, reverse_id,
    start, size: of the template) as texts. primers: primer_id, sequence (what pairs) and tail (what
    stands before it, may be null). Products whose molecule or primers are unknown, or which don't fit
    the molecule, have none and are left out."""
    own = primers.select("primer_id", F.upper("sequence").alias("own"), F.coalesce(F.upper("tail"), F.lit("")).alias("tail")).where("own IS NOT NULL").dropDuplicates(["primer_id"])
    side = lambda name: own.select(F.col("primer_id").alias(f"{name}_id"), F.col("own").alias(name), F.col("tail").alias(f"{name}_tail"))
    rows = products.select("seq_id", "forward_id", "reverse_id", F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size")).where("start IS NOT NULL AND size IS NOT NULL")
    rows = rows.join(side("forward"), "forward_id").join(side("reverse"), "reverse_id").withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string"), "circular": F.lit(None).cast("boolean")})
    held = mol.where("sequence IS NOT NULL AND seq_id IS NOT NULL").select("seq_id", F.lit(0).alias("kind"), F.upper("sequence").alias("text"), (F.col("topology") == "circular").alias("circular"))
    columns = ["seq_id", "kind", "text", "circular", "forward_id", "reverse_id", "start", "size", "forward", "reverse", "forward_tail", "reverse_tail"]
    both = held.unionByName(rows, allowMissingColumns=True).select(*columns).repartition("seq_id").sortWithinPartitions("seq_id", "kind")
    kinds = dict(both.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, template, circular = object(), None, False
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, out = [], []
                for k, (seq, kind, text, circle, _, _, start, size, f, r, ft, rt) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    if kind == 0:
                        now, template, circular = seq, text, bool(circle)
                        continue
                    found = product_text(template, circular, start, size, f, r, (ft, rt)) if seq == now else None
                    if found is not None:
                        at.append(k)
                        out.append(found)
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(index) for c in (0, 4, 5, 6, 7)), pa.array(out, pa.string())], names=["seq_id", "forward_id", "reverse_id", "start", "size", "sequence"])

    return both.mapInArrow(run, f"seq_id {kinds['seq_id']}, forward_id {kinds['forward_id']}, reverse_id {kinds['reverse_id']}, start bigint, size bigint, sequence string")
