"""Reads and primers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise import derive, dims
from strandwise.derive import with_views as views
from strandwise.functions import seq as S
from strandwise.operators import anneal as A
from strandwise.operators import reads as R
from strandwise.plans.registry import query


def _reads(spark, sf_dir):
    return derive.reads(spark, sf_dir).withColumn("quality", derive.qualities(F.col("quality")))


@query(views("bases") + "SELECT read_id, list(q ORDER BY i)::VARCHAR AS phred, sum(q)::BIGINT AS total FROM bases GROUP BY 1")
def phred_decode(spark, sf_dir):
    """Qualities through the text form of FASTQ and back."""
    text = F.array_join(F.transform("quality", lambda q: F.char(q + 33)), "")
    r = _reads(spark, sf_dir).select("read_id", S.phred(text).alias("q"))
    return r.select("read_id", F.concat(F.lit("["), F.array_join(F.transform("q", lambda x: x.cast("string")), ", "), F.lit("]")).alias("phred"), F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(views("bases", more="p AS (SELECT read_id, i, sum(0.05::DOUBLE - pow(10.0::DOUBLE, -q / 10.0::DOUBLE)) OVER (PARTITION BY read_id ORDER BY i) AS s FROM bases), f AS (SELECT *, coalesce(min(s) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM p), d AS (SELECT read_id, i, s, s - least(m, 0) AS run FROM f), best AS (SELECT read_id, max(run) AS best FROM d GROUP BY 1)") + "SELECT read_id, floor(greatest(best, 0) * 1e6 + 0.5)::BIGINT AS score_millionths FROM best")
def mott_trim(spark, sf_dir):
    """The score of the stretch kept by Mott's trimming."""
    kept = _reads(spark, sf_dir).select("read_id", "quality", S.mott_trim(F.col("quality")).alias("t"))
    held = F.slice("quality", F.col("t.start") + 1, F.col("t.end") - F.col("t.start"))
    score = F.aggregate(held, F.lit(0.0), lambda a, q: a + F.lit(0.05) - F.pow(F.lit(10.0), -q / 10.0))
    return kept.select("read_id", F.floor(score * 1e6 + 0.5).cast("bigint").alias("score_millionths"))


@query(views("bases") + "SELECT seq_id, start + i AS pos, base, count(*) AS depth, sum(q)::BIGINT AS quality FROM bases GROUP BY 1, 2, 3")
def pileup(spark, sf_dir):
    return R.pileup(_reads(spark, sf_dir)).groupBy("seq_id", F.col("pos").cast("bigint").alias("pos"), "base").agg(F.count("*").alias("depth"), F.sum("quality").alias("quality"))


@query(views("reads", more="steps AS (SELECT seq_id, \"at\", sum(d) AS d FROM (SELECT seq_id, start AS \"at\", 1 AS d FROM reads UNION ALL SELECT seq_id, start + 96, -1 FROM reads) GROUP BY 1, 2), runs AS (SELECT seq_id, \"at\" AS start, lead(\"at\") OVER w AS e, sum(d) OVER w AS depth FROM steps WHERE d <> 0 WINDOW w AS (PARTITION BY seq_id ORDER BY \"at\"))") + 'SELECT seq_id, start, e AS "end", depth::BIGINT AS depth FROM runs WHERE e IS NOT NULL AND depth > 0')
def coverage(spark, sf_dir):
    return R.coverage(derive.reads(spark, sf_dir), F.lit(96))


VOTES = "v AS (SELECT seq_id, start + i AS pos, base, least(60, greatest(1, q)) AS q FROM bases), s AS (SELECT seq_id, pos, count(*) AS depth, " + ", ".join(f"sum(CASE WHEN base = '{k}' THEN floor(ln(1 - pow(10.0::DOUBLE, -q / 10.0::DOUBLE)) * 1e6 + 0.5) ELSE floor(ln(pow(10.0::DOUBLE, -q / 10.0::DOUBLE) / 4) * 1e6 + 0.5) END)::BIGINT AS l{n}" for n, k in enumerate("ACGT-")) + " FROM v GROUP BY 1, 2), u AS (SELECT seq_id, pos, depth, k, exp((l - greatest(l0, l1, l2, l3, l4)) / 1e6::DOUBLE) AS w FROM s, LATERAL (VALUES (0, l0), (1, l1), (2, l2), (3, l3), (4, l4)) t(k, l)), m AS (SELECT *, w / sum(w) OVER (PARTITION BY seq_id, pos) AS p FROM u), o AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY seq_id, pos ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, first(k) OVER (PARTITION BY seq_id, pos ORDER BY p DESC, k) AS best FROM m), c AS (SELECT seq_id, pos, any_value(depth) AS depth, string_agg(substr('ACGT', k + 1, 1), '' ORDER BY k) AS bases, sum(p) AS covered FROM o WHERE best < 4 AND k < 4 AND before < 0.8 GROUP BY 1, 2), iupac(bases, symbol) AS (VALUES " + ", ".join(f"('{b}', '{c}')" for c, b in dims.IUPAC.items() if c != "U") + ")"


@query(views("bases", more=VOTES) + "SELECT seq_id, pos, depth, symbol, least(60, greatest(0, floor(-10 * log10(greatest(1e-6, 1 - covered)) + 0.5)))::INT AS quality, length(bases) > 1 AS ambiguous FROM c JOIN iupac USING (bases)")
def consensus(spark, sf_dir):
    """A base where the votes settle on one, else the code of the bases that make four fifths."""
    return R.consensus(R.pileup(_reads(spark, sf_dir))).withColumn("pos", F.col("pos").cast("bigint"))


@query(views("bases", more="d AS (SELECT b.seq_id, b.read_id, b.start + b.i AS pos, b.base <> substr(m.sequence, (b.start + b.i)::INT + 1, 1) AS x FROM bases b JOIN molecules m USING (seq_id)), v AS (SELECT seq_id, read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM d WHERE x)") + 'SELECT read_id, seq_id, min(pos) AS start, max(pos) + 1 AS "end" FROM v GROUP BY read_id, seq_id, island')
def variants_islands(spark, sf_dir):
    """Maximal runs of bases in which a read differs from its molecule."""
    r = _reads(spark, sf_dir).join(derive.molecules(spark, sf_dir).select("seq_id", "sequence"), "seq_id")
    want = F.substring("sequence", F.col("start") + 1, F.lit(96))
    d = r.select("read_id", "seq_id", "start", F.posexplode(F.zip_with(F.split("bases", ""), F.split(want, ""), lambda a, b: a != b)).alias("i", "x")).where("x")
    pos = (F.col("start") + F.col("i")).cast("bigint")
    d = d.withColumn("pos", pos).withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("read_id").orderBy("pos")))
    return d.groupBy("read_id", "seq_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


@query(views("reads") + "SELECT a.read_id, b.read_id AS mate_id, a.seq_id = b.seq_id AS together, (b.start - a.start)::INT AS apart FROM reads a JOIN reads b ON b.read_id = a.read_id + 1 WHERE a.read_id % 2 = 0")
def read_pairs(spark, sf_dir):
    r = derive.reads(spark, sf_dir)
    mate = r.where("read_id % 2 = 1").select((F.col("read_id") - 1).alias("read_id"), F.col("read_id").alias("mate_id"), F.col("seq_id").alias("s2"), F.col("start").alias("b"))
    return r.where("read_id % 2 = 0").join(mate, "read_id").select("read_id", "mate_id", (F.col("seq_id") == F.col("s2")).alias("together"), (F.col("b") - F.col("start")).alias("apart"))


@query(views("primers") + "SELECT lower(substr(name, 1, 16)) AS name, count(*) AS n FROM primers GROUP BY 1 HAVING count(*) > 1")
def pool_dup_names(spark, sf_dir):
    return derive.primers(spark, sf_dir).groupBy(F.lower(F.substring("name", 1, 16)).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query(views("primers") + "SELECT least(sequence, reverse(translate(sequence, 'ACGT', 'TGCA'))) AS bases, count(*) AS n, string_agg(primer_id::VARCHAR, ',' ORDER BY primer_id) AS ids FROM primers GROUP BY 1")
def pool_same_bases(spark, sf_dir):
    p = derive.primers(spark, sf_dir)
    g = p.groupBy(F.least("sequence", S.revcomp(F.col("sequence"))).alias("bases")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("primer_id")).alias("ids"))
    return g.select("bases", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


ANNEAL = "w AS (SELECT seq_id, i, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 19) ELSE sequence END, i + 1, 20) AS w FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= 492), sites AS (SELECT seq_id, i, 'forward' AS strand, w AS t FROM w UNION ALL SELECT seq_id, i, 'reverse', reverse(translate(w, 'ACGT', 'TGCA')) FROM w)"


@query(views("primers", more=ANNEAL) + "SELECT p.primer_id, s.seq_id, s.strand, s.i::INT AS start, hamming(p.sequence, s.t)::INT AS mismatches FROM primers p JOIN sites s ON substr(p.sequence, 16, 5) = substr(s.t, 16, 5) AND hamming(p.sequence, s.t) <= 2")
def anneal_sites(spark, sf_dir):
    """Places where a primer pairs: its last five bases exactly, two mismatches at most elsewhere."""
    return A.anneal_sites(derive.molecules(spark, sf_dir), derive.primers(spark, sf_dir)).drop("size")


@query(views("primers", more=ANNEAL + ", hit AS (SELECT p.primer_id, s.seq_id, s.strand, s.i FROM primers p JOIN sites s ON p.sequence = s.t), m AS (SELECT seq_id, topology FROM molecules)") + "SELECT f.seq_id, f.primer_id AS forward_id, r.primer_id AS reverse_id, f.i::INT AS start, (CASE WHEN r.i >= f.i THEN r.i + 20 - f.i ELSE r.i + 532 - f.i END)::INT AS size FROM hit f JOIN hit r ON f.seq_id = r.seq_id AND f.strand = 'forward' AND r.strand = 'reverse' JOIN m ON m.seq_id = f.seq_id WHERE r.i >= f.i OR m.topology = 'circular'")
def pcr_products(spark, sf_dir):
    """What pairs of exactly matching primers amplify; on a circle also across the origin."""
    sites = A.anneal_sites(derive.molecules(spark, sf_dir), derive.primers(spark, sf_dir), mismatches=0, keep=("seq_id", "topology", "length"))
    return A.amplicons(sites).drop("mismatches")


MISMATCHED = ", an AS (SELECT p.primer_id, s.seq_id, s.strand, s.i, hamming(p.sequence, s.t) AS mm FROM primers p JOIN sites s ON substr(p.sequence, 16, 5) = substr(s.t, 16, 5) AND hamming(p.sequence, s.t) <= 2), pr AS (SELECT f.seq_id, f.primer_id AS forward_id, r.primer_id AS reverse_id, f.i AS start, CASE WHEN r.i >= f.i THEN r.i + 20 - f.i ELSE r.i + 532 - f.i END AS size, f.mm + r.mm AS mismatches FROM an f JOIN an r ON f.seq_id = r.seq_id AND f.strand = 'forward' AND r.strand = 'reverse' JOIN molecules m ON m.seq_id = f.seq_id WHERE r.i >= f.i OR m.topology = 'circular'), rk AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY mismatches, size, start, forward_id, reverse_id) AS rank FROM pr WHERE size <= 5000)"


@query(views("primers", more=ANNEAL + MISMATCHED) + "SELECT seq_id, forward_id, reverse_id, start::INT AS start, size::INT AS size, mismatches::INT AS mismatches, rank FROM rk WHERE rank <= 12")
def pcr_ranked(spark, sf_dir):
    """The twelve likeliest products of each molecule, mismatched primers included."""
    sites = A.anneal_sites(derive.molecules(spark, sf_dir), derive.primers(spark, sf_dir), keep=("seq_id", "topology", "length"))
    return A.best_products(A.amplicons(sites, reach=5000)).withColumn("rank", F.col("rank").cast("bigint"))


@query(views("primers", more="q AS (SELECT *, row_number() OVER (ORDER BY primer_id) - 1 AS k FROM primers)") + "SELECT primer_id, (k // 96 + 1)::INT AS plate, chr((65 + (k % 96) % 8)::INT) || lpad(((k % 96) // 8 + 1)::VARCHAR, 2, '0') AS well, sequence FROM q")
def order_sheet_wells(spark, sf_dir):
    """Plates of 96 wells, filled down the columns. One order's primers are numbered by rank within
    ranges of ids: counts of the ranges before give each its offset, so no window holds them all."""
    p = derive.primers(spark, sf_dir).withColumn("part", F.floor(F.col("primer_id") / 1000))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = p.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    k = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("primer_id")) - 1
    rows = p.join(offsets, "part").withColumn("k", k)
    at = F.col("k") % 96
    return rows.select("primer_id", (F.floor(F.col("k") / 96) + 1).cast("int").alias("plate"), F.concat(F.char(at % 8 + 65), F.lpad((F.floor(at / 8) + 1).cast("string"), 2, "0")).alias("well"), "sequence")


VOTE = "r AS (SELECT read_id, seq_id, CASE WHEN read_id % 2 = 1 THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END AS b FROM reads), k AS (SELECT DISTINCT read_id, seq_id, substr(b, i + 1, 11) AS w FROM r, range(86) t(i)), mk AS (SELECT DISTINCT seq_id, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 10) ELSE sequence END, i + 1, 11) AS w FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= 501), n AS (SELECT k.read_id, count(f.w) AS forward, count(v.w) AS reverse FROM k LEFT JOIN mk f ON f.seq_id = k.seq_id AND f.w = k.w LEFT JOIN mk v ON v.seq_id = k.seq_id AND v.w = reverse(translate(k.w, 'ACGT', 'TGCA')) GROUP BY 1)"


@query(views("reads", more=VOTE) + "SELECT read_id, forward, reverse, CASE WHEN forward >= 20 AND forward >= 3 * reverse THEN 'forward' WHEN reverse >= 20 AND reverse >= 3 * forward THEN 'reverse' END AS strand FROM n")
def strand_vote(spark, sf_dir):
    """The strand of its molecule with which a read shares clearly more 11-mers."""
    r = derive.reads(spark, sf_dir).withColumn("bases", F.when(F.col("read_id") % 2 == 1, S.revcomp(F.col("bases"))).otherwise(F.col("bases")))
    return R.strand_vote(r, derive.molecules(spark, sf_dir))


NAMES = "n AS (SELECT read_id, 'clone' || (read_id // 3) || CASE read_id % 3 WHEN 0 THEN '_F' WHEN 1 THEN '-rev' ELSE '.2' END AS name FROM reads), s AS (SELECT read_id, regexp_replace(lower(name), '[-_. ]?(forward|fwd|for|f|reverse|rev|r|1|2)$', '') AS clone, CASE WHEN regexp_matches(lower(name), '[-_. ](forward|fwd|for|f|1)$') THEN 'forward' WHEN regexp_matches(lower(name), '[-_. ](reverse|rev|r|2)$') THEN 'reverse' END AS way FROM n)"


@query(views("reads", more=NAMES) + "SELECT clone, count(*) FILTER (way = 'forward') AS n_forward, count(*) FILTER (way = 'reverse') AS n_reverse, min(read_id) FILTER (way = 'forward') AS first_forward, min(read_id) FILTER (way = 'reverse') AS first_reverse FROM s GROUP BY 1")
def mates_by_name(spark, sf_dir):
    """Reads of one clone by what their names say of direction."""
    k = F.col("read_id")
    name = F.concat(F.lit("clone"), F.floor(k / 3).cast("string"), F.when(k % 3 == 0, "_F").when(k % 3 == 1, "-rev").otherwise(".2"))
    return R.mates_by_name(derive.reads(spark, sf_dir).select("read_id", name.alias("name")))


@query(views("molecules", more="t AS (SELECT seq_id, topology, sequence AS a, CASE WHEN topology = 'circular' THEN substr(sequence, o + 1) || substr(sequence, 1, o) ELSE sequence END AS r FROM (SELECT *, (seq_id * 7 % 512)::INT AS o FROM molecules))") + "SELECT seq_id, CASE WHEN topology = 'circular' THEN (512 - seq_id * 7 % 512) % 512 ELSE 0 END::INT AS origin, seq_id % 3 = 0 AS flipped FROM t")
def turn_to_match(spark, sf_dir):
    """How copies of molecules that start elsewhere, some read from the other strand, must be turned."""
    k = F.col("seq_id")
    m = derive.molecules(spark, sf_dir)
    at = (k * 7 % 512).cast("int")
    turned = F.when(F.col("topology") == "circular", F.concat(F.substring("sequence", at + 1, F.lit(512)), F.substring("sequence", F.lit(1), at))).otherwise(F.col("sequence"))
    other = F.when(k % 3 == 0, S.revcomp(turned)).otherwise(turned)
    return R.turn_to_match(m.select("seq_id", "topology", "sequence", other.alias("other")), ["seq_id"])
