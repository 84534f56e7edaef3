"""Interval algebra on lines and circles, and the overlap join.

A range is 0-based and half-open; on a circle its end may pass the length, and end - start is
always its size. Comparisons go through ``pieces``, which cut a range at the origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pieces(start: Column, end: Column, length: Column) -> Column:
    """array<struct<s, e>>: one piece, or two where the range passes the origin."""
    one = lambda s, e: F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    return F.when(end <= length, F.array(one(start, end))).otherwise(F.array(one(start, length), one(F.lit(0), end - length)))


def contains(start: Column, end: Column, position: Column, length: Column) -> Column:
    return F.pmod(position - start, length) < end - start


def shift_insert(start: Column, end: Column, at: Column, count: Column) -> tuple[Column, Column]:
    """After an insertion on a line: inside a range it grows it, at its first base it pushes it."""
    return start + F.when(start >= at, count).otherwise(0), end + F.when((start >= at) | (end > at), count).otherwise(0)


def shift_delete(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """After deleting low:high on a line; start = end where nothing is left of the range."""
    move = lambda p: F.when(p <= low, p).when(p >= high, p - (high - low)).otherwise(low)
    return move(start), move(end)


def rotate(start: Column, end: Column, origin: Column, length: Column) -> tuple[Column, Column]:
    new = F.pmod(start - origin, length)
    return new, new + (end - start)


def flip(start: Column, end: Column, length: Column, circular: Column) -> tuple[Column, Column]:
    """After the whole sequence is turned round."""
    new = F.when(circular, F.pmod(length - end, length)).otherwise(length - end)
    return new, new + (end - start)


def exploded_pieces(df: DataFrame, length: int | Column, keep: list[str], width: int) -> DataFrame:
    """keep, s, e, bin: a row for each piece and each bin of ``width`` it touches."""
    df = df.select(*keep, F.explode(pieces(F.col("start"), F.col("end"), F.lit(length))).alias("p")).select(*keep, "p.s", "p.e").where("e > s")
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))


def overlap_join(left: DataFrame, right: DataFrame, on: str, length: int | Column, width: int = 64) -> DataFrame:
    """Pairs (left_id, right_id) of ranges on the same molecule that share a base.

    Both sides have ``on``, id, start and end; length is the molecules', a number or a column that both
    sides have. Pieces are dealt to bins and joined by (molecule,
    bin), so a long molecule with many features spreads over its bins; a pair is reported in the
    bin of the later of its two starts only, so no distinct is needed within a pair of pieces.
    """
    a = exploded_pieces(left, length, [on, "id"], width).withColumnRenamed("id", "left_id")
    b = exploded_pieces(right, length, [on, "id"], width).select(on, "bin", F.col("id").alias("right_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    hit = a.join(b, [on, "bin"]).where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & (F.col("bin") == F.floor(F.greatest("s", "s2") / width)))
    return hit.select(on, "left_id", "right_id").distinct()


def delete_on_circle(start: Column, end: Column, low: Column, high: Column, length: Column) -> Column:
    """struct<start, end> of a range after low:high was deleted on a circle (high may pass the length;
    start < end <= start + length), null where nothing is left. What is left of the circle starts with
    its first base that stays, so a deletion across the origin moves the origin to its end."""
    tail = F.greatest(high - length, F.lit(0))  # bases deleted behind the origin
    gone = high - low
    left = length - gone
    # unrolled so that the deletion ends at 0: a base p of this turn stands at p - high, the kept bases are 0 .. left - 1
    at = lambda p: F.pmod(p - high, length)
    first = F.when(at(start) < left, at(start)).otherwise(F.lit(0))
    size = end - start
    skipped = F.when(at(start) < left, 0).otherwise(length - at(start))  # deleted bases at its front
    reach = F.when(at(start) < left, at(start)).otherwise(F.lit(0)) + size - skipped  # its end, from the end of the deletion
    inside = F.when(reach <= left, reach - first).when(reach <= length, left - first).otherwise(left - first + reach - length)
    new = F.pmod(first + F.when(tail > 0, F.lit(0)).otherwise(low), F.greatest(left, F.lit(1)))
    return F.when((inside > 0) & (left > 0), F.struct(new.cast("bigint").alias("start"), (new + F.least(inside, left)).cast("bigint").alias("end")))


def style_runs(styles: DataFrame, key: str) -> DataFrame:
    """key, start, end, style: the maximal runs of equal style on a line, where the range (start, end)
    with the largest ``rank`` wins; bases without a style are in no run. Boundaries cut a molecule into
    elementary stretches, ranges meet only the stretches they cover, so no base is a row."""
    cuts = styles.select(key, F.explode(F.array("start", "end")).alias("at")).distinct()
    w = Window.partitionBy(key).orderBy("at")
    parts = cuts.select(key, F.col("at").alias("s"), F.lead("at").over(w).alias("e")).where("e IS NOT NULL")
    hit = styles.join(parts, key).where((F.col("start") <= F.col("s")) & (F.col("e") <= F.col("end")))
    best = hit.groupBy(key, "s", "e").agg(F.max_by("style", "rank").alias("style"))
    w = Window.partitionBy(key).orderBy("s")
    new = F.when((F.lag("e").over(w) == F.col("s")) & (F.lag("style").over(w) == F.col("style")), 0).otherwise(1)
    runs = best.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.min("style").alias("style")).drop("run")


def swallowed(features: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """feature, deletion: the smallest deletion (key, deletion, low, high) that holds a feature (key,
    feature, start, end) whole, on lines."""
    pairs = features.join(deletions, key).where((F.col("low") <= F.col("start")) & (F.col("end") <= F.col("high")))
    w = Window.partitionBy(key, "feature").orderBy(F.col("high") - F.col("low"), "deletion")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "feature", "deletion")
