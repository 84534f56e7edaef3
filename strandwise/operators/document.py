"""Edits of whole molecules and of what they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.seq import let, positions, revcomp


def insert(seq: Column, at: Column, text: Column) -> Column:
    """text put in before position at (clipped to the sequence)."""
    k = F.least(F.greatest(at, F.lit(0)), F.length(seq))
    return F.concat(F.substring(seq, F.lit(1), k), text, F.substring(seq, k + 1, F.length(seq)))


def delete(seq: Column, start: Column, end: Column, circular: Column) -> Column:
    """The sequence without start:end; on a circle the range may pass the origin, and what is left
    then starts behind it."""
    n = F.length(seq)
    line = F.concat(F.substring(seq, F.lit(1), start), F.substring(seq, end + 1, n))
    return F.when(circular & (end > n), F.substring(seq, end - n + 1, start - (end - n))).otherwise(line)


def replace(seq: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.substring(seq, F.lit(1), start), text, F.substring(seq, end + 1, F.length(seq)))


def set_origin(seq: Column, at: Column) -> Column:
    """A circle written from another base on."""
    k = F.pmod(at, F.greatest(F.length(seq), F.lit(1)))
    return F.concat(F.substring(seq, k + 1, F.length(seq)), F.substring(seq, F.lit(1), k))


def overlap(left: Column, right: Column, least: int, most: int) -> Column:
    """The longest suffix of left that is a prefix of right, from least to most bases; 0 if none."""
    sizes = F.sequence(F.lit(most), F.lit(least), F.lit(-1))
    return F.coalesce(F.get(F.filter(sizes, lambda k: (F.length(left) >= k) & (F.length(right) >= k) & (F.substring(left, -k, k) == F.substring(right, F.lit(1), k))), F.lit(0)), F.lit(0))


def ligate(parts: DataFrame, key: str, order: str, sequence: str) -> DataFrame:
    """key, sequence, parts: each key's sequences one after another, by order. A product is one row:
    its parts are as many as one tube holds."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, sequence))).alias("p"))
    return g.select(key, F.array_join(F.transform("p", lambda x: x[sequence]), "").alias("sequence"), F.size("p").alias("parts"))


def hunks_of(a: Column, b: Column) -> Column:
    """array<struct<start, end>>: maximal runs of positions at which two sequences of one length
    differ."""
    n = F.least(F.length(a), F.length(b))
    differs = F.slice(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), F.lit(1), F.greatest(n, F.lit(0)))

    def runs(d: Column) -> Column:
        edge = lambda step: F.filter(positions(n), lambda i: F.get(d, i) & ~F.coalesce(F.get(d, i + step), F.lit(False)))
        return F.zip_with(edge(-1), edge(1), lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))

    return let(differs, runs)


def both_strands(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement: one spelling for both strands."""
    return F.least(seq, revcomp(seq))
