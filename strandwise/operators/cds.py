"""Coding sequences of several segments: reading positions, codons, translation, residue numbers.

Segments are unrolled ranges (on a circle an end may pass the length) in ascending order; everything
is read in the direction of the strand. Codons are rows; the genetic codes are a fixed table of some
1,700 rows that they are joined with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.functions.seq import positions, revcomp, translate_codon


def reading_positions(segments: Column, strand: Column, length: Column) -> Column:
    """The positions of an array<struct<s, e>> in reading order, each within 0 .. length - 1."""
    all_ = F.flatten(F.transform(segments, lambda x: F.transform(positions((x["e"] - x["s"]).cast("int")), lambda i: F.pmod(x["s"] + i, length).cast("int"))))
    return F.when(strand == "reverse", F.reverse(all_)).otherwise(all_)


def spliced(sequence: Column, segments: Column, strand: Column) -> Column:
    """The bases of the segments in reading order, in upper case."""
    text = F.array_join(F.transform(segments, lambda x: F.substring(F.concat(sequence, sequence), x["s"] + 1, x["e"] - x["s"])), "")
    return F.upper(F.when(strand == "reverse", revcomp(text)).otherwise(text))


def codons(cds: DataFrame, keep: list[str]) -> DataFrame:
    """keep, number, codon, aa, first, middle, last, split: a row for each whole codon of each CDS.

    cds: sequence, length, segments array<struct<s, e>>, strand, codon_start (1 to 3, null: 1),
    transl_table (null or unknown: 1), partial (the 5' end is open; null: no), exceptions
    array<struct<codon, aa>> (residues that overrule the code, by codon number; null: none). The
    first codon reads M where it is a start of the table and the end isn't open. Ambiguous codons
    read as all their readings agree in the standard code, else X. A codon is split when its bases
    are no three neighbours."""
    known = F.when(F.col("transl_table").isin([c[0] for c in dims.GENETIC_CODES]), F.col("transl_table")).otherwise(1)
    skip = F.coalesce(F.col("codon_start"), F.lit(1)) - 1
    rows = cds.select(
        *keep, "strand", "length", "exceptions", known.alias("table_id"), skip.alias("skip_"), F.coalesce("partial", F.lit(False)).alias("partial_"),
        reading_positions(F.col("segments"), F.col("strand"), F.col("length")).alias("places_"), spliced(F.col("sequence"), F.col("segments"), F.col("strand")).alias("bases_"),
    )
    n = F.floor((F.size("places_") - F.col("skip_")) / 3).cast("int")
    rows = rows.withColumn("i", F.explode(positions(n)))
    low = F.col("skip_") + F.col("i") * 3
    step = F.when(F.col("strand") == "reverse", -1).otherwise(1)
    ruled = F.get(F.filter("exceptions", lambda x: x["codon"] == F.col("i") + 1), F.lit(0))["aa"]
    rows = rows.select(*keep, "strand", "length", "table_id", "partial_", "i", ruled.alias("ruled_"), F.substring("bases_", low + 1, F.lit(3)).alias("codon"), *(F.get("places_", low + k).alias(c) for k, c in enumerate(("first", "middle", "last"))))
    code = dims.genetic_codes(cds.sparkSession).select("table_id", F.col("codon").alias("plain_"), "aa", "is_start")
    rows = rows.withColumn("plain_", F.translate("codon", "U", "T")).join(F.broadcast(code), ["table_id", "plain_"], "left")
    aa = F.coalesce("ruled_", F.when((F.col("i") == 0) & ~F.col("partial_") & F.col("is_start"), "M"), "aa", translate_codon(F.col("codon")))
    beside = lambda a, b: F.pmod(F.col(b) - F.col(a), F.col("length")) == F.pmod(step, F.col("length"))
    return rows.select(*keep, (F.col("i") + 1).alias("number"), "codon", aa.alias("aa"), "first", "middle", "last", (~(beside("first", "middle") & beside("middle", "last"))).alias("split"))


def proteins(codon_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, protein, residues: the residues of each CDS in order."""
    g = codon_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "aa"))).alias("x"))
    return g.select(*keys, F.array_join(F.transform("x", lambda c: c["aa"]), "").alias("protein"), F.size("x").cast("bigint").alias("residues"))


def checked_translation(stored: Column, computed: Column) -> Column:
    """How a stored translation relates to the computed one (its last stop left out): same, shorter or
    longer by one part, different, or none where nothing is stored."""
    own = F.regexp_replace(computed, r"\*$", "")
    return F.when(stored.isNull(), "none").when(stored == own, "same").when(F.startswith(own, stored), "shorter").when(F.startswith(stored, own), "longer").otherwise("different")


def numbered_residues(codon_rows: DataFrame, keep: list[str], every: int = 10) -> DataFrame:
    """keep, number, position: the first residue and every tenth, over its codon's middle base."""
    rows = codon_rows.where((F.col("number") == 1) | (F.col("number") % every == 0))
    return rows.select(*keep, "number", F.col("middle").alias("position"))
