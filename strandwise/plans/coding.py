"""Coding sequences of several segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise import derive, dims
from strandwise.derive import with_views as views
from strandwise.operators import cds
from strandwise.plans.registry import query

#: Two segments with a gap between them, on circles across the origin too; codon_start, table and exception by id.
GENES = "genes AS (SELECT DISTINCT feature_id || ':' || seq_id || ':' || start || ':' || \"end\" || strand AS gene, *, start AS s1, start + half AS e1, start + half + gap AS s2, \"end\" + gap AS e2 FROM (SELECT feature_id, seq_id, topology, strand, start, \"end\", (\"end\" - start) // 2 + feature_id % 3 AS half, 5 + feature_id % 7 AS gap, 1 + feature_id % 3 AS skip, CASE feature_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 11 ELSE 1 END AS tbl FROM features WHERE type = 'CDS' AND \"end\" - start > 12) WHERE topology = 'circular' OR \"end\" + gap <= 512)"
CODES = "codes(tbl, codon, aa, start_) AS (VALUES " + ", ".join(f"({i}, '{c}', '{a}', {'true' if s == 'M' else 'false'})" for i, _, acids, starts in dims.GENETIC_CODES if i in (1, 2, 11) for c, a, s in zip(dims.CODONS, acids, starts, strict=True)) + ")"
READ = (
    GENES + ", " + CODES + ", pos AS (SELECT gene, feature_id, seq_id, strand, skip, tbl, p % 512 AS p, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = 'reverse' THEN -p ELSE p END) - 1 AS r FROM (SELECT genes.*, unnest(list_concat(range(s1, e1), range(s2, e2))) AS p FROM genes)),"
    " base AS (SELECT p.*, (r - skip + 1) // 3 AS k, (r - skip + 1) % 3 AS j, CASE WHEN strand = 'reverse' THEN translate(substr(m.sequence, p::INT + 1, 1), 'ACGT', 'TGCA') ELSE substr(m.sequence, p::INT + 1, 1) END AS b FROM pos p JOIN molecules m USING (seq_id) WHERE r >= skip - 1),"
    " cod AS (SELECT gene, feature_id, any_value(tbl) AS tbl, any_value(strand) AS strand, k, string_agg(b, '' ORDER BY j) AS codon, arg_min(p, j) AS first, min(p) FILTER (j = 1) AS middle, arg_max(p, j) AS last FROM base GROUP BY gene, feature_id, k HAVING count(*) = 3),"
    " aas AS (SELECT gene, feature_id, k, first, middle, last, strand, codon, CASE WHEN k = feature_id % 4 THEN 'U' WHEN k = 0 AND start_ THEN 'M' ELSE aa END AS aa FROM cod JOIN codes USING (tbl, codon))"
)


def _cds(spark, sf_dir):
    f = derive.features(spark, sf_dir).where("type = 'CDS' AND end - start > 12")
    k = F.col("feature_id")
    half, gap = F.floor((F.col("end") - F.col("start")) / 2) + k % 3, 5 + k % 7
    seg = lambda a, b: F.struct(a.cast("int").alias("s"), b.cast("int").alias("e"))
    f = f.where((F.col("topology") == "circular") | (F.col("end") + gap <= derive.LENGTH))
    f = f.withColumn("segments", F.array(seg(F.col("start"), F.col("start") + half), seg(F.col("start") + half + gap, F.col("end") + gap)))
    f = f.withColumns({"codon_start": (1 + k % 3).cast("int"), "transl_table": F.when(k % 5 == 0, 2).when(k % 5 == 1, 11).otherwise(1), "partial": F.lit(False), "exceptions": F.array(F.struct((k % 4 + 1).cast("int").alias("codon"), F.lit("U").alias("aa")))})
    rows = f.join(derive.molecules(spark, sf_dir).select("seq_id", "length", "sequence"), "seq_id")
    gene = F.concat_ws(":", "feature_id", "seq_id", "start", F.concat("end", "strand"))
    return cds.codons(rows.withColumn("gene", gene).dropDuplicates(["gene"]), ["gene", "feature_id"])


@query(views("features", more=READ) + "SELECT gene, string_agg(aa, '' ORDER BY k) AS protein, count(*) AS residues FROM aas GROUP BY 1")
def cds_joined(spark, sf_dir):
    """Translation of joined segments with codon_start, genetic code and exceptions."""
    return cds.proteins(_cds(spark, sf_dir), ["gene"])


@query(views("features", more=READ) + "SELECT gene, k + 1 AS number, codon, first::INT AS first, last::INT AS last FROM aas WHERE NOT (((middle - first + 512) % 512 = CASE strand WHEN 'reverse' THEN 511 ELSE 1 END) AND ((last - middle + 512) % 512 = CASE strand WHEN 'reverse' THEN 511 ELSE 1 END))")
def split_codons(spark, sf_dir):
    """Codons that a join cuts."""
    rows = _cds(spark, sf_dir).where("split")
    return rows.select("gene", F.col("number").cast("bigint").alias("number"), "codon", "first", "last")


@query(views("features", more=READ) + "SELECT gene, (k + 1)::INT AS number, middle::INT AS position FROM aas WHERE k = 0 OR (k + 1) % 10 = 0")
def residue_numbers(spark, sf_dir):
    return cds.numbered_residues(_cds(spark, sf_dir), ["gene"])


@query(views("features", more=READ + ", prot AS (SELECT gene, feature_id, string_agg(aa, '' ORDER BY k) AS p FROM aas GROUP BY 1, 2), own AS (SELECT gene, feature_id, regexp_replace(p, '\\*$', '') AS p FROM prot), stored AS (SELECT *, CASE feature_id % 4 WHEN 0 THEN p WHEN 1 THEN substr(p, 1, length(p) - 2) WHEN 2 THEN p || 'K' END AS s FROM own)") + "SELECT gene, CASE WHEN s IS NULL THEN 'none' WHEN s = p THEN 'same' WHEN starts_with(p, s) THEN 'shorter' WHEN starts_with(s, p) THEN 'longer' ELSE 'different' END AS state FROM stored")
def stored_translation(spark, sf_dir):
    """Stored translations beside the computed ones."""
    c = cds.proteins(_cds(spark, sf_dir), ["gene", "feature_id"]).withColumnRenamed("protein", "p")
    own, k = F.regexp_replace("p", r"\*$", ""), F.col("feature_id") % 4
    stored = F.when(k == 0, own).when(k == 1, F.substring(own, F.lit(1), F.greatest(F.length(own) - 2, F.lit(0)))).when(k == 2, F.concat(own, F.lit("K")))
    return c.select("gene", cds.checked_translation(stored, F.col("p")).alias("state"))
