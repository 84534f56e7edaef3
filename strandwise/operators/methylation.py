"""Dam and Dcm methylation of a host's DNA and the cut sites it blocks.

A methylated base is a row (molecule, methylase, strand, position). An enzyme lists configurations,
sets of bases in its site that must be methylated; each site asks for the bases of each of its
configurations by an equi-join on positions, and a configuration holds when all are found. Nothing
looks at the sequence around a site again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.operators import scan


def methylated_bases(mol: DataFrame) -> DataFrame:
    """seq_id, kind, strand (0 top, 1 bottom), at: the bases Dam and Dcm methylate, in top-strand
    coordinates; on a circle also those of a motif across the origin."""
    out = None
    for kind, motif, top, bottom in dims.METHYLASES:
        hits = scan.motif(mol, motif, ["seq_id", "topology", "length"])
        both = F.array(*[F.struct(F.lit(s).alias("strand"), (F.col("start") + k).alias("p")) for s, k in ((0, top), (1, bottom))])
        rows = hits.select("seq_id", "topology", "length", F.lit(kind).alias("kind"), F.inline(both))
        rows = rows.select("seq_id", "kind", "strand", F.when(F.col("topology") == "circular", F.pmod("p", F.col("length"))).otherwise(F.col("p")).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out


def asked_bases(enzymes: DataFrame) -> list[tuple]:
    """(enzyme, strand of the site, kind, configuration, strand, offset) of every base that a listed
    configuration asks for, or that an enzyme sensitive to any methylated base may have in its site.
    A site on the reverse strand is read mirrored; a palindrome's configurations also read from the
    other strand."""
    rows = []
    for e in enzymes.collect():  # the catalogue
        n = len(e.site)
        for kind, listed in dims.METHYL_CONFIGURATIONS.get(e.name, {}).items():
            ways = [(0, t, 1, b) for t, b in listed]
            if e.palindromic:
                ways += [(0, [n - 1 - p for p in b], 1, [n - 1 - p for p in t]) for t, b in listed]
            for k, (_, top, _, bottom) in enumerate(ways):
                for strand in ("forward",) if e.palindromic else ("forward", "reverse"):
                    turn = strand == "reverse"
                    for s, places in ((0, top), (1, bottom)):
                        rows += [(e.name, strand, kind, k, 1 - s if turn else s, n - 1 - p if turn else p) for p in places]
        for kind in dims.METHYL_ANY.get(e.name, ()):
            for strand in ("forward", "reverse"):
                rows += [(e.name, strand, kind, 1000 + 2 * p + s, s, p) for p in range(n) for s in (0, 1)]
    return rows


def blocked_sites(mol: DataFrame, enzymes: DataFrame, dam: bool = True, dcm: bool = True) -> DataFrame:
    """seq_id, enzyme, strand, site_start, kind: cut sites that the host's methylases block or impair."""
    asked = asked_bases(enzymes)
    spark = mol.sparkSession
    table = spark.createDataFrame(asked, "enzyme string, strand string, kind string, config int, side int, offset int")
    needs = table.groupBy("enzyme", "strand", "kind", "config").agg(F.count("*").alias("needed"), F.collect_list(F.struct("side", "offset")).alias("bases"))
    names = sorted({r[0] for r in asked})
    own = enzymes.where(F.col("name").isin(names)) if names else enzymes.where("false")
    kinds = [k for k, on in (("Dam", dam), ("Dcm", dcm)) if on]
    if not names or not kinds:
        return spark.createDataFrame([], f"seq_id {dict(mol.dtypes)['seq_id']}, enzyme string, strand string, site_start int, kind string")
    sites = scan.cut_sites(mol, own).select("seq_id", "enzyme", "strand", "site_start")
    sites = sites.join(F.broadcast(needs.where(F.col("kind").isin(kinds))), ["enzyme", "strand"]).join(mol.select("seq_id", "topology", "length"), "seq_id")
    rows = sites.select("seq_id", "enzyme", "strand", "site_start", "kind", "config", "needed", "topology", "length", F.inline("bases"))
    at = F.col("site_start") + F.col("offset")
    rows = rows.withColumn("at", F.when(F.col("topology") == "circular", F.pmod(at, F.col("length"))).otherwise(at)).drop("offset", "topology", "length")
    there = methylated_bases(mol).select("seq_id", "kind", F.col("strand").alias("side"), "at")
    hit = rows.join(there, ["seq_id", "kind", "side", "at"]).groupBy("seq_id", "enzyme", "strand", "site_start", "kind", "config", "needed").agg(F.count("*").alias("n"))
    return hit.where("n >= needed").select("seq_id", "enzyme", "strand", "site_start", "kind").distinct()


def cuttable_sites(mol: DataFrame, enzymes: DataFrame, dam: bool = True, dcm: bool = True) -> DataFrame:
    """The cut sites of DNA that such a host has grown."""
    blocked = blocked_sites(mol, enzymes, dam, dcm).select("seq_id", "enzyme", "strand", "site_start").distinct()
    return scan.cut_sites(mol, enzymes).join(blocked, ["seq_id", "enzyme", "strand", "site_start"], "left_anti")
