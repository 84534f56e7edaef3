"""Features: interval algebra, overlap joins, extraction, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise import derive, dims
from strandwise.derive import with_views as views
from strandwise.functions import seq as S
from strandwise.operators import intervals as I
from strandwise.plans.registry import query

N = derive.LENGTH
PIECES = f"pieces AS (SELECT feature_id, seq_id, type, start AS s, least(\"end\", {N}) AS e FROM features UNION ALL SELECT feature_id, seq_id, type, 0, \"end\" - {N} FROM features WHERE \"end\" > {N})"
CODE = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in dims.code_table(1).items()) + ")"
EXTRACT = f"cut AS (SELECT f.*, substr(m.sequence || m.sequence, f.start::INT + 1, (f.\"end\" - f.start)::INT) AS t FROM features f JOIN molecules m USING (seq_id)), extracted AS (SELECT *, CASE WHEN strand = 'reverse' THEN reverse(translate(t, 'ACGT', 'TGCA')) ELSE t END AS bases FROM cut)"


def _extracted(spark, sf_dir):
    f = derive.features(spark, sf_dir)
    m = derive.molecules(spark, sf_dir).select("seq_id", "sequence")
    t = F.substring(F.concat("sequence", "sequence"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return f.join(m, "seq_id").withColumn("bases", F.when(F.col("strand") == "reverse", S.revcomp(t)).otherwise(t)).drop("sequence")


@query(views("features", more=PIECES) + "SELECT DISTINCT a.seq_id, a.feature_id AS left_id, b.feature_id AS right_id FROM pieces a JOIN pieces b ON a.seq_id = b.seq_id AND a.s < b.e AND b.s < a.e WHERE a.type = 'CDS' AND b.type = 'gene'")
def feature_overlap(spark, sf_dir):
    f = derive.features(spark, sf_dir).withColumnRenamed("feature_id", "id")
    return I.overlap_join(f.where("type = 'CDS'").select("seq_id", "id", "start", "end"), f.where("type = 'gene'").select("seq_id", "id", "start", "end"), "seq_id", N)


@query(views("features") + f"SELECT seq_id, feature_id FROM features WHERE ((100 - start) % {N} + {N}) % {N} < \"end\" - start")
def feature_at(spark, sf_dir):
    f = derive.features(spark, sf_dir)
    return f.where(I.contains(F.col("start"), F.col("end"), F.lit(100), F.lit(N))).select("seq_id", "feature_id")


@query(views("features") + "SELECT feature_id, start + CASE WHEN start >= 200 THEN 7 ELSE 0 END AS start, \"end\" + CASE WHEN start >= 200 OR \"end\" > 200 THEN 7 ELSE 0 END AS \"end\" FROM features WHERE topology = 'linear'")
def feature_shift_insert(spark, sf_dir):
    f = derive.features(spark, sf_dir).where("topology = 'linear'")
    s, e = I.shift_insert(F.col("start"), F.col("end"), F.lit(200), F.lit(7))
    return f.select("feature_id", s.alias("start"), e.alias("end"))


@query(views("features", more="moved AS (SELECT feature_id, CASE WHEN start <= 150 THEN start WHEN start >= 260 THEN start - 110 ELSE 150 END AS s, CASE WHEN \"end\" <= 150 THEN \"end\" WHEN \"end\" >= 260 THEN \"end\" - 110 ELSE 150 END AS e FROM features WHERE topology = 'linear' AND \"end\" > start)") + "SELECT feature_id, s AS start, e AS \"end\" FROM moved WHERE e > s")
def feature_shift_delete(spark, sf_dir):
    f = derive.features(spark, sf_dir).where("topology = 'linear' AND end > start")
    s, e = I.shift_delete(F.col("start"), F.col("end"), F.lit(150), F.lit(260))
    return f.select("feature_id", s.alias("start"), e.alias("end")).where("end > start")


@query(views("features") + f"SELECT feature_id, ((start - 37) % {N} + {N}) % {N} AS start, ((start - 37) % {N} + {N}) % {N} + \"end\" - start AS \"end\" FROM features WHERE topology = 'circular'")
def rotate_origin(spark, sf_dir):
    f = derive.features(spark, sf_dir).where("topology = 'circular'")
    s, e = I.rotate(F.col("start"), F.col("end"), F.lit(37), F.lit(N))
    return f.select("feature_id", s.alias("start"), e.alias("end"))


@query(views("features", more=f"turned AS (SELECT feature_id, \"end\" - start AS size, CASE WHEN topology = 'circular' THEN (({N} - \"end\") % {N} + {N}) % {N} ELSE {N} - \"end\" END AS start FROM features)") + 'SELECT feature_id, start, start + size AS "end" FROM turned')
def flip_features(spark, sf_dir):
    f = derive.features(spark, sf_dir)
    s, e = I.flip(F.col("start"), F.col("end"), F.lit(N), F.col("topology") == "circular")
    return f.select("feature_id", s.alias("start"), e.alias("end"))


@query(views("features", more=EXTRACT) + "SELECT feature_id, seq_id, bases FROM extracted")
def extract_region(spark, sf_dir):
    return _extracted(spark, sf_dir).select("feature_id", "seq_id", "bases")


@query(views("features", more=EXTRACT + ", " + CODE + ", codons AS (SELECT DISTINCT feature_id, bases, k, substr(bases, 3 * k + 1, 3) AS codon FROM extracted, range(55) r(k) WHERE type = 'CDS' AND 3 * k + 3 <= length(bases)), prot AS (SELECT feature_id, bases, string_agg(aa, '' ORDER BY k) AS protein FROM codons JOIN code USING (codon) GROUP BY 1, 2)") + "SELECT e.feature_id, coalesce(p.protein, '') AS protein FROM extracted e LEFT JOIN prot p USING (feature_id, bases) WHERE e.type = 'CDS'")
def cds_translate(spark, sf_dir):
    return _extracted(spark, sf_dir).where("type = 'CDS'").select("feature_id", S.translate(F.col("bases")).alias("protein"))


@query(views("features", more=EXTRACT) + "SELECT feature_id, length(bases) % 3 <> 0 AS partial_codon, substr(bases, 1, 3) <> 'ATG' AS no_start, coalesce(substr(bases, length(bases) - 2, 3) NOT IN ('TAA', 'TAG', 'TGA'), true) AS no_stop FROM extracted WHERE type = 'CDS'")
def translation_check(spark, sf_dir):
    e = _extracted(spark, sf_dir).where("type = 'CDS'")
    last = F.substring(F.col("bases"), F.length("bases") - 2, F.lit(3))
    return e.select("feature_id", (F.length("bases") % 3 != 0).alias("partial_codon"), (F.substring("bases", 1, 3) != "ATG").alias("no_start"), (~last.isin("TAA", "TAG", "TGA")).alias("no_stop"))


@query(views("features", more="a AS (SELECT seq_id, start, any_value(type) AS type, count(*) AS n FROM features WHERE strand = 'forward' GROUP BY 1, 2), b AS (SELECT seq_id, start, any_value(type) AS type, count(*) AS n FROM features WHERE strand = 'reverse' GROUP BY 1, 2)") + "SELECT coalesce(a.seq_id, b.seq_id) AS seq_id, coalesce(a.start, b.start) AS start, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.seq_id = b.seq_id AND a.start = b.start")
def feature_diff_full_outer(spark, sf_dir):
    f = derive.features(spark, sf_dir)
    side = lambda s, n: f.where(F.col("strand") == s).groupBy("seq_id", "start").agg(F.count("*").alias(n))
    state = F.when(F.col("nb").isNull(), "removed").when(F.col("na").isNull(), "added").when(F.col("na") != F.col("nb"), "changed").otherwise("same")
    return side("forward", "na").join(side("reverse", "nb"), ["seq_id", "start"], "full").select("seq_id", "start", state.alias("state"))


@query(views("features") + "SELECT type, strand, grouping(type)::INT AS g_type, grouping(strand)::INT AS g_strand, count(*) AS n, sum(\"end\" - start)::BIGINT AS bases FROM features GROUP BY GROUPING SETS ((type, strand), (type), ())")
def grouping_sets_extra(spark, sf_dir):
    f = derive.features(spark, sf_dir).select("type", "strand", (F.col("end") - F.col("start")).alias("size"))
    g = f.groupingSets([["type", "strand"], ["type"], []], "type", "strand")
    return g.agg(F.grouping("type").cast("int").alias("g_type"), F.grouping("strand").cast("int").alias("g_strand"), F.count("*").alias("n"), F.sum("size").alias("bases"))


@query(views("features") + "SELECT seq_id, count(*) FILTER (type = 'CDS') AS cds, count(*) FILTER (type = 'gene') AS gene, max(\"end\" - start)::BIGINT AS longest FROM features GROUP BY 1")
def feature_counts(spark, sf_dir):
    f = derive.features(spark, sf_dir)
    return f.groupBy("seq_id").agg(F.count(F.when(F.col("type") == "CDS", 1)).alias("cds"), F.count(F.when(F.col("type") == "gene", 1)).alias("gene"), F.max(F.col("end") - F.col("start")).alias("longest"))


CIRC = "f AS (SELECT DISTINCT feature_id, start, \"end\" AS e, (feature_id * 31 % 512)::BIGINT AS low, (feature_id * 31 % 512 + 5 + feature_id % 60)::BIGINT AS high FROM features WHERE topology = 'circular'), b AS (SELECT DISTINCT feature_id, start, e, low, high, p FROM f, range(0, 200) t(k), LATERAL (SELECT (start + k) % 512 AS p) WHERE start + k < e AND NOT (p BETWEEN low AND high - 1 OR p + 512 BETWEEN low AND high - 1)), m AS (SELECT *, CASE WHEN high > 512 THEN p - (high - 512) WHEN p >= high THEN p - (high - low) ELSE p END AS q, 512 - (high - low) AS n FROM b)"


@query(views("features", more=CIRC + ", g AS (SELECT feature_id, start, e, n, count(*) AS size, list(q) AS qs FROM m GROUP BY 1, 2, 3, 4)") + "SELECT feature_id, start, e AS old_end, size, list_aggregate([x FOR x IN qs IF size = n OR NOT list_contains(qs, (x + n - 1) % n)], 'min')::BIGINT AS first FROM g WHERE size < n")
def delete_on_circles(spark, sf_dir):
    """Features of circles after a stretch was deleted, some across the origin."""
    f = derive.features(spark, sf_dir).where("topology = 'circular'").distinct()
    k = F.col("feature_id")
    low = (k * 31 % 512).cast("bigint")
    d = f.withColumn("d", I.delete_on_circle(F.col("start"), F.col("end"), low, low + 5 + k % 60, F.lit(N).cast("bigint"))).where("d IS NOT NULL")
    return d.select("feature_id", "start", F.col("end").alias("old_end"), (F.col("d.end") - F.col("d.start")).alias("size"), F.col("d.start").alias("first")).distinct()


@query(views("features", more="c AS (SELECT seq_id, i, arg_max(type || strand, feature_id * 1000 + \"end\") AS style FROM (SELECT DISTINCT * FROM features WHERE topology = 'linear' AND \"end\" > start) f, range(512) t(i) WHERE i >= f.start AND i < f.\"end\" GROUP BY 1, 2), r AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, style ORDER BY i) AS island FROM c)") + "SELECT seq_id, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS \"end\", style FROM r GROUP BY seq_id, style, island")
def style_runs(spark, sf_dir):
    """What style each stretch of a line is drawn in when later features lie over earlier ones."""
    f = derive.features(spark, sf_dir).where("topology = 'linear' AND end > start").distinct()
    s = f.select("seq_id", "start", "end", F.concat("type", "strand").alias("style"), (F.col("feature_id") * 1000 + F.col("end")).alias("rank"))
    return I.style_runs(s, "seq_id")


@query(views("features", more="d AS (SELECT seq_id, k AS deletion, (seq_id * 17 + k * 61) % 400 AS low, (seq_id * 17 + k * 61) % 400 + 40 + k * 25 AS high FROM molecules, range(4) t(k) WHERE topology = 'linear'), h AS (SELECT f.seq_id, f.feature_id AS feature, deletion, row_number() OVER (PARTITION BY f.seq_id, f.feature_id ORDER BY high - low, deletion) AS r FROM features f JOIN d ON d.seq_id = f.seq_id AND low <= f.start AND f.\"end\" <= high WHERE f.topology = 'linear')") + "SELECT seq_id, feature, deletion FROM h WHERE r = 1")
def swallowed_features(spark, sf_dir):
    """Which of several deletions took each feature whole: the smallest that holds it."""
    m = derive.molecules(spark, sf_dir).where("topology = 'linear'")
    one = lambda k: F.struct(F.lit(k).cast("bigint").alias("deletion"), ((F.col("seq_id") * 17 + k * 61) % 400).alias("low"), ((F.col("seq_id") * 17 + k * 61) % 400 + 40 + k * 25).alias("high"))
    d = m.select("seq_id", F.inline(F.array(*[one(k) for k in range(4)])))
    f = derive.features(spark, sf_dir).where("topology = 'linear'").select("seq_id", F.col("feature_id").alias("feature"), "start", "end")
    return I.swallowed(f, d, "seq_id")


@query(views("molecules") + "SELECT seq_id, translate(sequence, 'Tt', 'Uu') AS rna FROM molecules")
def rna_letters(spark, sf_dir):
    m = derive.molecules(spark, sf_dir)
    return m.select("seq_id", F.translate("sequence", "Tt", "Uu").alias("rna"))
