"""Edits of molecules, joins of fragments, recoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise import derive
from strandwise.derive import with_views as views
from strandwise.functions import seq as S
from strandwise.operators import document as D
from strandwise.operators.scan import kmers
from strandwise.plans.features import CODE, EXTRACT, _extracted
from strandwise.plans.registry import query

AT = "(seq_id * 13 % 500)::INT"


def _mol(spark, sf_dir):
    return derive.molecules(spark, sf_dir).withColumn("at", (F.col("seq_id") * 13 % 500).cast("int"))


@query(views("molecules") + f"SELECT seq_id, substr(sequence, 1, {AT}) || 'NNN' || substr(sequence, {AT} + 1) AS sequence FROM molecules")
def edit_insert(spark, sf_dir):
    return _mol(spark, sf_dir).select("seq_id", D.insert(F.col("sequence"), F.col("at"), F.lit("NNN")).alias("sequence"))


@query(views("molecules") + f"SELECT seq_id, CASE WHEN topology = 'circular' AND {AT} + 40 > 512 THEN substr(sequence, {AT} + 40 - 512 + 1, {AT} - ({AT} + 40 - 512)) ELSE substr(sequence, 1, {AT}) || substr(sequence, {AT} + 41) END AS sequence FROM molecules")
def edit_delete(spark, sf_dir):
    return _mol(spark, sf_dir).select("seq_id", D.delete(F.col("sequence"), F.col("at"), F.col("at") + 40, F.col("topology") == "circular").alias("sequence"))


@query(views("molecules") + f"SELECT seq_id, substr(sequence, 1, {AT}) || 'acgt' || substr(sequence, {AT} + 10) AS sequence FROM molecules")
def edit_replace(spark, sf_dir):
    return _mol(spark, sf_dir).select("seq_id", D.replace(F.col("sequence"), F.col("at"), F.col("at") + 9, F.lit("acgt")).alias("sequence"))


@query(views("molecules") + f"SELECT seq_id, substr(sequence, {AT} + 1) || substr(sequence, 1, {AT}) AS sequence FROM molecules WHERE topology = 'circular'")
def set_origin(spark, sf_dir):
    return _mol(spark, sf_dir).where("topology = 'circular'").select("seq_id", D.set_origin(F.col("sequence"), F.col("at")).alias("sequence"))


@query(views("molecules", more="p AS (SELECT seq_id, k, substr(sequence, k * 128 + 1, 128 + 4 * k + 16) AS part, substr(sequence, (k + 1) * 128 + 1, 128) AS next FROM molecules, range(3) t(k))") + "SELECT seq_id, k::INT AS k, coalesce((SELECT max(n) FROM range(15, 41) r(n) WHERE right(part, n::INT) = left(next, n::INT)), 0)::INT AS overlap FROM p")
def gibson_overlaps(spark, sf_dir):
    """The homology of each part of a molecule with the next, 15 to 40 bases."""
    part = lambda k: F.struct(F.lit(k).alias("k"), F.substring("sequence", k * 128 + 1, 128 + 4 * k + 16).alias("part"), F.substring("sequence", (k + 1) * 128 + 1, 128).alias("next"))
    p = derive.molecules(spark, sf_dir).select("seq_id", F.explode(F.array(*[part(k) for k in range(3)])).alias("p"))
    return p.select("seq_id", "p.k", D.overlap(F.col("p.part"), F.col("p.next"), 15, 40).alias("overlap"))


@query(views("molecules", more="p AS (SELECT seq_id // 4 AS tube, seq_id, sequence AS part FROM molecules)") + "SELECT tube, string_agg(part, '' ORDER BY seq_id) AS sequence, count(*)::INT AS parts FROM p GROUP BY 1")
def ligate_concat(spark, sf_dir):
    p = derive.molecules(spark, sf_dir).select(F.floor(F.col("seq_id") / 4).alias("tube"), "seq_id", F.col("sequence").alias("part"))
    return D.ligate(p, "tube", "seq_id", "part")


@query(views("molecules", more="v AS (SELECT seq_id, i, substr(sequence, i + 1, 1) <> substr(translate(sequence, CASE seq_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'G' END, 'T'), i + 1, 1) AS x FROM molecules, range(512) t(i)), d AS (SELECT seq_id, i, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS island FROM v WHERE x)") + 'SELECT seq_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM d GROUP BY seq_id, island')
def sequence_diff(spark, sf_dir):
    """Where each molecule differs from a version with one of its bases turned to T."""
    base = F.when(F.col("seq_id") % 3 == 0, F.translate("sequence", "A", "T")).when(F.col("seq_id") % 3 == 1, F.translate("sequence", "C", "T")).otherwise(F.translate("sequence", "G", "T"))
    return derive.molecules(spark, sf_dir).select("seq_id", F.inline(D.hunks_of(F.col("sequence"), base)))


FAV = "every AS (SELECT feature_id, bases, k, substr(bases, 3 * k + 1, 3) AS codon FROM extracted, range(55) r(k) WHERE type = 'CDS' AND 3 * k + 3 <= length(bases)), n AS (SELECT codon, aa, count(*) AS n FROM every JOIN code USING (codon) GROUP BY 1, 2), fav AS (SELECT aa, first(codon ORDER BY n DESC, codon) AS best FROM n GROUP BY 1), one AS (SELECT DISTINCT feature_id, bases, k, best FROM every JOIN code USING (codon) JOIN fav USING (aa))"


@query(views("features", more=EXTRACT + ", " + CODE + ", " + FAV) + "SELECT feature_id, bases, string_agg(best, '' ORDER BY k) AS recoded FROM one GROUP BY 1, 2")
def recode_cds(spark, sf_dir):
    """Every CDS in the favourite codons of all CDS: at most 21 rows, taken as a literal map."""
    b = _extracted(spark, sf_dir).where("type = 'CDS'").select("feature_id", "bases").distinct()
    n = F.floor(F.length("bases") / 3).cast("int")
    counts = _extracted(spark, sf_dir).where("type = 'CDS'").select(F.explode(F.transform(S.positions(n), lambda k: F.substring("bases", k * 3 + 1, F.lit(3)))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n")).withColumn("aa", S.translate_codon(F.col("codon")))
    w = Window.partitionBy("aa").orderBy(F.desc("n"), "codon")
    best = counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("aa", "codon").collect()
    favourite = F.create_map(*[F.lit(x) for r in best for x in (r.aa, r.codon)] or [F.lit(""), F.lit("")])
    rows = b.withColumn("p", S.translate(F.col("bases")))
    return rows.where("p <> ''").select("feature_id", "bases", F.array_join(F.transform(F.filter(F.split("p", ""), lambda a: a != ""), lambda a: F.try_element_at(favourite, a)), "").alias("recoded"))


@query(views("molecules", more="k AS (SELECT DISTINCT seq_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT seq_id, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 10) ELSE sequence END, i + 1, 11) AS s FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= 501))") + "SELECT kmer, count(*) AS molecules FROM k GROUP BY 1 HAVING count(*) > 1")
def shared_kmers(spark, sf_dir):
    """11-mers, either strand, that more than one molecule has."""
    k = kmers(derive.molecules(spark, sf_dir), 11).select("seq_id", D.both_strands(F.col("kmer")).alias("kmer")).distinct()
    return k.groupBy("kmer").agg(F.count("*").alias("molecules")).where("molecules > 1")
