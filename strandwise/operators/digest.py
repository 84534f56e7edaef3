"""Digests: fragments between cuts, gel bands, partial digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fragments(mol: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, size: what a complete digest leaves.

    mol: keys, topology, length (a row for each molecule, or molecule and enzyme); cuts: keys, cut.
    On a line cuts at the ends don't count; a circle cut once opens to one whole-turn fragment, an
    uncut one stays whole. Windows run over one molecule's cuts, never over a whole table.
    """
    circular, n = F.col("topology") == "circular", F.col("length")
    points = cuts.join(mol, keys).select(*keys, "topology", "length", F.when(circular, F.pmod("cut", n)).otherwise(F.col("cut")).alias("cut")).distinct()
    inner = points.where(circular | ((F.col("cut") > 0) & (F.col("cut") < n)))
    ends = mol.where(~circular & (n > 0)).select(*keys, "topology", "length", F.explode(F.array(F.lit(0), n.cast("int"))).alias("cut"))
    bounds = inner.unionByName(ends)
    w = Window.partitionBy(*keys).orderBy("cut")
    first = F.first("cut").over(w)
    spans = bounds.select(*keys, "topology", "length", F.col("cut").alias("start"), F.lead("cut").over(w).alias("next"), first.alias("first"))
    end = F.coalesce("next", F.when(circular, F.col("first") + n))
    cut = spans.withColumn("end", end).where(F.col("end").isNotNull()).select(*keys, "start", "end")
    whole = mol.where(circular & (n > 0)).join(inner.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("start"), n.cast("int").alias("end"))
    return cut.unionByName(whole).withColumn("size", F.col("end") - F.col("start"))


def gel_bands(frags: DataFrame, keys: list[str], resolution: float = 1.15) -> DataFrame:
    """keys, band, size, n: fragments that run together, by single linkage down the sizes."""
    w = Window.partitionBy(*keys).orderBy(F.desc("size"), "start")
    above = F.lag("size").over(w)
    new = F.when(above.isNull() | (above.cast("double") / F.col("size") >= resolution), 1).otherwise(0)
    banded = frags.withColumn("new", new).withColumn("band", F.sum("new").over(w))
    return banded.groupBy(*keys, "band").agg(F.max("size").alias("size"), F.count("*").alias("n"))


def partial_fragments(mol: DataFrame, cuts: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys, start, end, uncut: the spans of a partial digest; ``uncut`` sites lie within.

    On a circle every start with 1 .. n cuts onward, on a line every pair of stops. Pairs arise
    within one molecule's stops; ``most`` keeps those with the fewest uncut sites, then the longest.
    """
    circular, n = F.col("topology") == "circular", F.col("length")
    points = cuts.join(mol, keys).select(*keys, "topology", "length", F.when(circular, F.pmod("cut", n)).otherwise(F.col("cut")).alias("cut")).where(circular | ((F.col("cut") > 0) & (F.col("cut") < n))).distinct()
    stops = points.unionByName(mol.where(~circular & (n > 0)).select(*keys, "topology", "length", F.explode(F.array(F.lit(0), n.cast("int"))).alias("cut")))
    per = stops.groupBy(*keys, "topology", "length").agg(F.array_sort(F.collect_list("cut")).alias("stops"))
    k = F.size("stops")
    turn = lambda i: F.get("stops", F.pmod(i, k)) + F.floor(i / k).cast("int") * n.cast("int")
    one = per.select(*keys, "topology", "length", "stops", F.explode(F.sequence(F.lit(0), k - 1)).alias("i")).where(circular | (F.col("i") < k - 1))
    step = F.when(circular, k).otherwise(k - 1 - F.col("i"))
    two = one.withColumn("d", F.explode(F.sequence(F.lit(1), step))).select(*keys, F.get("stops", F.col("i")).alias("start"), turn(F.col("i") + F.col("d")).alias("end"), (F.col("d") - 1).alias("uncut"))
    if most is not None:
        w = Window.partitionBy(*keys).orderBy("uncut", F.desc(F.col("end") - F.col("start")), "start")
        two = two.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return two
