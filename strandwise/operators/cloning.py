"""Overhangs, ligation fidelity, ordered assembly, modular plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.seq import count_in, revcomp


def overhang_warnings(overhangs: DataFrame, key: str) -> DataFrame:
    """key, overhang, warning: palindromic overhangs, those without or of only G and C, and those
    that another of the same set (or its reverse complement) repeats."""
    o = F.col("overhang")
    own = overhangs.select(key, "overhang", F.least(o, revcomp(o)).alias("pair"))
    repeats = own.groupBy(key, "pair").agg(F.count("*").alias("n"))
    gc = count_in(o, "GC")
    kinds = F.array(
        F.when(o == revcomp(o), "palindrome"),
        F.when(gc == 0, "no GC"),
        F.when(gc == F.length(o), "all GC"),
        F.when(F.col("n") > 1, "repeated"),
    )
    return own.join(repeats, [key, "pair"]).select(key, "overhang", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("warning"))


def set_fidelity(junctions: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key, fidelity: the product over a set's junctions of the ligations with the right partner
    over all with any overhang of the set.

    junctions: key, overhang (a set's distinct overhangs, bounded by its parts); counts: top,
    bottom, n (how often an overhang was seen joined with another).
    """
    ends = junctions.select(key, "overhang").unionByName(junctions.select(key, revcomp(F.col("overhang")).alias("overhang"))).distinct()
    seen = ends.select(key, F.col("overhang").alias("top")).join(ends.select(key, F.col("overhang").alias("bottom")), key).join(counts, ["top", "bottom"])
    on = F.col("bottom") == revcomp(F.col("top"))
    per = seen.groupBy(key, F.least("top", revcomp(F.col("top"))).alias("j")).agg(F.sum(F.when(on, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("all"))
    return per.groupBy(key).agg(F.exp(F.sum(F.log(F.col("good") / F.col("all")))).alias("fidelity"))


def ordered_assembly(parts: DataFrame, key: str, most: int) -> DataFrame:
    """key, order, closed: the walk over parts (key, part_id, left, right, body) from the smallest
    part id, by overhangs, each step to the one part that fits; unresolved where more than one fits
    or the walk doesn't close over all parts. ``most`` bounds the parts of a set, and so the steps.
    """
    size = parts.groupBy(key).agg(F.count("*").alias("parts"), F.min("part_id").alias("first"))
    only = parts.groupBy(key, "left").agg(F.count("*").alias("fits"), F.min("part_id").alias("part_id"), F.min("right").alias("right"))
    first = size.join(parts, [F.col("first") == F.col("part_id"), size[key] == parts[key]]).select(size[key], "parts", F.array("part_id").alias("order"), F.col("left").alias("goal"), F.col("right").alias("at"), F.lit(True).alias("clear"))
    walk = first
    for _ in range(most - 1):
        nxt = only.select(F.col(key).alias("k2"), F.col("left").alias("l2"), "fits", F.col("part_id").alias("p2"), F.col("right").alias("r2"))
        step = walk.join(nxt, (F.col(key) == F.col("k2")) & (F.col("at") == F.col("l2")), "left")
        go = F.col("p2").isNotNull() & ~F.array_contains("order", F.col("p2")) & (F.size("order") < F.col("parts"))
        walk = step.select(key, "parts", F.when(go, F.concat("order", F.array("p2"))).otherwise(F.col("order")).alias("order"), "goal", F.when(go, F.col("r2")).otherwise(F.col("at")).alias("at"), (F.col("clear") & F.when(go, F.col("fits") == 1).otherwise(True)).alias("clear"))
    closed = F.col("clear") & (F.size("order") == F.col("parts")) & (F.col("at") == F.col("goal"))
    return walk.select(key, F.array_join(F.transform("order", lambda x: x.cast("string")), "-").alias("order"), closed.alias("closed"))
