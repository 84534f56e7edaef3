"""Digests with ends, ligation partners, homology and overhang assemblies, catalogue choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise import derive, dims
from strandwise.derive import with_views as views
from strandwise.operators import ends, scan
from strandwise.plans.registry import query
from strandwise.plans.sequence import CUTS, ENZ

TUBE = ("HinfI", "NlaIII", "AluI", "EcoRI", "BamHI", "PstI")
TEXT = "CASE WHEN topology = 'circular' THEN sequence || sequence ELSE sequence END"
FRAGMENTS = (
    CUTS
    + f", ct AS (SELECT m.seq_id, m.topology, {TEXT} AS t, c.cut, min(c.cut_bottom) AS bot FROM cuts c JOIN molecules m USING (seq_id) WHERE c.enzyme IN {TUBE} AND (m.topology = 'circular' OR (c.cut > 0 AND c.cut < 512)) GROUP BY ALL),"
    " cd AS (SELECT *, CASE WHEN topology = 'circular' THEN ((bot - cut + 256) % 512 + 512) % 512 - 256 ELSE bot - cut END AS d FROM ct),"
    " ce AS (SELECT seq_id, topology, t, cut, CASE WHEN d = 0 THEN 'blunt' WHEN d > 0 THEN 'five_prime' ELSE 'three_prime' END AS kind, substr(t, (CASE WHEN topology = 'circular' THEN ((least(cut, cut + d) % 512) + 512) % 512 ELSE least(cut, cut + d) END)::INT + 1, abs(d)::INT) AS o FROM cd),"
    f" pts AS (SELECT * FROM ce UNION ALL SELECT seq_id, topology, {TEXT}, unnest([0, 512])::INT, 'end', '' FROM molecules WHERE topology = 'linear'),"
    " sp AS (SELECT seq_id, t, cut AS start, coalesce(lead(cut) OVER w, CASE WHEN topology = 'circular' THEN first(cut) OVER w + 512 END) AS e, kind AS left_kind, o AS left_overhang, coalesce(lead(kind) OVER w, first(kind) OVER w) AS right_kind, coalesce(lead(o) OVER w, first(o) OVER w) AS right_overhang FROM pts WINDOW w AS (PARTITION BY seq_id ORDER BY cut)),"
    " frags AS (SELECT seq_id, start, e::INT AS \"end\", left_kind, left_overhang, right_kind, right_overhang, substr(t, start + 1, (e - start)::INT) AS sequence FROM sp WHERE e IS NOT NULL)"
)


def _fragments(spark, sf_dir):
    mol = derive.molecules(spark, sf_dir)
    enzymes = dims.enzymes(spark, [e for e in dims.ENZYMES if e[0] in TUBE])
    return ends.cut_fragments(mol, scan.cut_sites(mol, enzymes).select("seq_id", "cut", "cut_bottom"))


@query(views("molecules", more=FRAGMENTS) + "SELECT * FROM frags")
def digest_ends(spark, sf_dir):
    """Fragments of a digest with six enzymes and the ends they have."""
    return _fragments(spark, sf_dir)


@query(views("molecules", more=FRAGMENTS + ", tube AS (SELECT *, seq_id // 20 AS tube FROM frags)") + "SELECT a.seq_id, a.start, count(*) AS partners FROM tube a JOIN tube b ON a.tube = b.tube AND a.right_kind = b.left_kind AND a.right_overhang = b.left_overhang WHERE a.right_kind <> 'end' AND length(a.right_overhang) >= 3 GROUP BY 1, 2")
def ligation_partners(spark, sf_dir):
    """How many left ends of its tube each sticky right end of three bases or more joins."""
    f = _fragments(spark, sf_dir).withColumn("tube", F.floor(F.col("seq_id") / 20))
    rows = f.where((F.col("right_kind") != "end") & (F.length("right_overhang") >= 3)).select("tube", "seq_id", "start", F.col("right_kind").alias("kind"), F.col("right_overhang").alias("overhang"))
    left = f.where("left_kind <> 'end'").groupBy("tube", F.col("left_kind").alias("kind"), F.col("left_overhang").alias("overhang")).agg(F.count("*").alias("n"))
    return rows.join(left, ["tube", "kind", "overhang"]).groupBy("seq_id", "start").agg(F.sum("n").alias("partners"))


BOTTOM = "b AS (SELECT *, CASE left_kind WHEN 'five_prime' THEN substr(sequence, length(left_overhang) + 1) WHEN 'three_prime' THEN left_overhang || sequence ELSE sequence END AS x FROM frags), bb AS (SELECT *, CASE right_kind WHEN 'five_prime' THEN x || right_overhang WHEN 'three_prime' THEN substr(x, 1, length(x) - length(right_overhang)) ELSE x END AS y FROM b)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query(views("molecules", more=FRAGMENTS + ", " + BOTTOM) + f"SELECT seq_id, start, \"end\", right_kind AS left_kind, {RC.format('right_overhang')} AS left_overhang, left_kind AS right_kind, {RC.format('left_overhang')} AS right_overhang, {RC.format('y')} AS sequence FROM bb")
def turned_fragments(spark, sf_dir):
    """The same fragments as they read from the other strand."""
    return ends.turned_fragment(_fragments(spark, sf_dir))


GIB = "p AS (SELECT seq_id AS tube, k, substr(sequence || sequence, k * 128 + 1, 128 + 15 + (seq_id % 20)::INT) AS part FROM molecules, range(4) t(k))"


@query(views("molecules", more=GIB) + "SELECT seq_id AS tube, sequence AS product FROM molecules")
def homology_circle(spark, sf_dir):
    """Four overlapping parts of each molecule joined to the circle they come from."""
    part = lambda k: F.struct(F.lit(k).alias("k"), F.substring(F.concat("sequence", "sequence"), F.lit(k * 128 + 1), (F.lit(143) + F.col("seq_id") % 20).cast("int")).alias("sequence"))
    p = derive.molecules(spark, sf_dir).select(F.col("seq_id").alias("tube"), F.inline(F.array(*[part(k) for k in range(4)])))
    return ends.homology_products(p, "tube", "k").select("tube", "product")


@query(views("molecules") + "SELECT seq_id AS tube, sequence AS product, CASE WHEN seq_id % 2 = 0 THEN '0-1-2r-3' ELSE '0-1-2-3' END AS \"order\" FROM molecules WHERE len(list_distinct([x FOR x IN [substr(sequence, 1, 4), substr(sequence, 129, 4), substr(sequence, 257, 4), substr(sequence, 385, 4)]] || [reverse(translate(x, 'ACGT', 'TGCA')) FOR x IN [substr(sequence, 1, 4), substr(sequence, 129, 4), substr(sequence, 257, 4), substr(sequence, 385, 4)]])) = 8")
def overhang_circle(spark, sf_dir):
    """Four pieces of each molecule with four-base overhangs, one of them turned round in every other
    tube, where the overhangs allow one order only."""
    m = derive.molecules(spark, sf_dir)
    o = F.array(*[F.substring("sequence", k * 128 + 1, 4) for k in range(4)])
    own = F.concat(o, F.transform(o, lambda x: F.reverse(F.translate(x, "ACGT", "TGCA"))))
    m = m.where(F.size(F.array_distinct(own)) == 8)
    def piece(k):
        left, right = F.substring("sequence", k * 128 + 1, 4), F.substring("sequence", (k + 1) % 4 * 128 + 1, 4)
        body = F.substring("sequence", k * 128 + 1, 128)
        turn = (F.col("seq_id") % 2 == 0) & F.lit(k == 2)
        rc = lambda x: F.reverse(F.translate(x, "ACGT", "TGCA"))
        return F.struct(F.lit(k).alias("piece_id"), F.when(turn, rc(right)).otherwise(left).alias("left"), F.when(turn, rc(left)).otherwise(right).alias("right"), F.when(turn, rc(F.concat(F.substring(body, 5, 124), right))).otherwise(body).alias("body"))
    p = m.select(F.col("seq_id").alias("tube"), F.inline(F.array(*[piece(k) for k in range(4)])))
    return ends.golden_gate_products(p, "tube").select("tube", "product", "order")


@query(views("molecules") + "SELECT seq_id AS tube, sequence AS product, '0-1-2-3' AS \"order\", '' AS problem FROM molecules WHERE NOT contains(sequence || sequence, 'GGTCTC') AND NOT contains(sequence || sequence, 'GAGACC') AND len(list_distinct([x FOR x IN [substr(sequence, 1, 4), substr(sequence, 129, 4), substr(sequence, 257, 4), substr(sequence, 385, 4)]] || [reverse(translate(x, 'ACGT', 'TGCA')) FOR x IN [substr(sequence, 1, 4), substr(sequence, 129, 4), substr(sequence, 257, 4), substr(sequence, 385, 4)]])) = 8")
def golden_gate_donors(spark, sf_dir):
    """Each molecule from four donor plasmids cut by BsaI in one tube, where it has no site of its own
    and the overhangs allow one order only."""
    m = derive.molecules(spark, sf_dir)
    o = F.array(*[F.substring("sequence", k * 128 + 1, 4) for k in range(4)])
    turned = F.transform(o, lambda x: F.reverse(F.translate(x, "ACGT", "TGCA")))
    twice = F.concat("sequence", "sequence")
    m = m.where(~twice.contains("GGTCTC") & ~twice.contains("GAGACC") & (F.size(F.array_distinct(F.concat(o, turned))) == 8))
    donor = lambda k: F.struct((F.col("seq_id") * 4 + k).alias("id"), F.concat(F.lit("TTGGTCTCA"), F.substring(twice, k * 128 + 1, 132), F.lit("TGAGACCAATTCCGGAATTCCGG")).alias("donor"))
    d = m.select(F.col("seq_id").alias("tube"), F.inline(F.array(*[donor(k) for k in range(4)])))
    d = d.select("tube", F.col("id").alias("seq_id"), F.lit("circular").alias("topology"), F.length("donor").alias("length"), F.col("donor").alias("sequence"))
    return ends.golden_gate_digest(d)


@query(views("molecules", more=CUTS) + "SELECT seq_id, enzyme, list(site_start::BIGINT ORDER BY site_start, strand)::VARCHAR AS sites, count(*) AS n FROM cuts GROUP BY 1, 2")
def packed_sites(spark, sf_dir):
    """All sites of an enzyme in a molecule as one sorted array."""
    s = scan.cut_sites(derive.molecules(spark, sf_dir), dims.enzymes(spark))
    g = s.groupBy("seq_id", "enzyme").agg(F.array_sort(F.collect_list("site_start")).alias("sites"))
    return g.select("seq_id", "enzyme", F.concat(F.lit("["), F.array_join(F.transform("sites", lambda x: x.cast("string")), ", "), F.lit("]")).alias("sites"), F.size("sites").cast("bigint").alias("n"))


@query(views("molecules", more=CUTS + ", n AS (SELECT seq_id, enzyme, count(*) AS n FROM cuts GROUP BY 1, 2)") + "SELECT seq_id, string_agg(enzyme, ',' ORDER BY enzyme) AS single_cutters, count(*) AS n FROM n WHERE n = 1 GROUP BY 1")
def single_cutters(spark, sf_dir):
    s = scan.cut_sites(derive.molecules(spark, sf_dir), dims.enzymes(spark)).groupBy("seq_id", "enzyme").agg(F.count("*").alias("n")).where("n = 1")
    return s.groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_list("enzyme")), ",").alias("single_cutters"), F.count("*").alias("n"))


@query(views("molecules", more=CUTS + ", " + ENZ + ", n AS (SELECT seq_id, enzyme, count(*) AS n FROM cuts GROUP BY 1, 2), r AS (SELECT seq_id, enzyme, n, row_number() OVER (PARTITION BY seq_id ORDER BY n, length(site) DESC, enzyme) AS rank FROM n JOIN enzymes USING (enzyme))") + "SELECT seq_id, enzyme, n, rank FROM r WHERE rank <= 6")
def default_enzymes(spark, sf_dir):
    """The six enzymes a check digest of each molecule starts with: few cuts, long sites first."""
    e = dims.enzymes(spark).select(F.col("name").alias("enzyme"), F.length("site").alias("size"))
    s = scan.cut_sites(derive.molecules(spark, sf_dir), dims.enzymes(spark)).groupBy("seq_id", "enzyme").agg(F.count("*").alias("n")).join(F.broadcast(e), "enzyme")
    w = Window.partitionBy("seq_id").orderBy("n", F.desc("size"), "enzyme")
    return s.select("seq_id", "enzyme", "n", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 6")
