"""Scalars and scans over molecules."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise import derive, dims
from strandwise.derive import with_views as views
from strandwise.functions import seq as S
from strandwise.operators import digest, orf, scan
from strandwise.plans.registry import query

RC = "reverse(translate({0}, 'ACGTRYSN', 'TGCAYRSN'))"


def _codons(name: str, table: int = 1) -> str:
    rows = ", ".join(f"('{c}', '{a}')" for c, a in dims.code_table(table).items())
    return f"{name}(codon, aa) AS (VALUES {rows})"


ENZ = "enzymes(enzyme, site, top, bottom) AS (VALUES " + ", ".join(f"('{n}', '{s}', {t}, {b})" for n, s, t, b in dims.ENZYMES) + ")"


def _core(site: str) -> str:
    """A site's longest run of plain bases, with its offset: '3, ACG'. Windows are found by it."""
    runs = re.finditer("[ACGT]+", site)
    best = max(runs, key=lambda m: len(m[0]), default=None)
    return f"{best.start()}, '{best[0]}'" if best else "0, ''"


#: Cut sites of every enzyme, for DuckDB: windows by a run of plain bases, then by regular expression.
PATTERNS = "patterns(enzyme, n, rule, strand, top, bottom, off, core) AS (VALUES " + ", ".join(
    row
    for n, s, t, b in dims.ENZYMES
    for row in [f"('{n}', {len(s)}, '{S.iupac_class(s)}', 'forward', {t}, {b}, {_core(s)})"]
    + ([] if dims.revcomp(s) == s else [f"('{n}', {len(s)}, '{S.iupac_class(dims.revcomp(s))}', 'reverse', {len(s) - b}, {len(s) - t}, {_core(dims.revcomp(s))})"])
) + ")"
CUTS = PATTERNS + """, win AS (SELECT seq_id, topology, length, n, i, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, n - 1) ELSE sequence END, i + 1, n) AS word FROM molecules, (SELECT DISTINCT n FROM patterns), range(512) r(i) WHERE topology = 'circular' OR i <= 512 - n),
words AS (SELECT DISTINCT n, word FROM win),
cored AS (SELECT n, word, off, substr(word, off + 1, len) AS core FROM words JOIN (SELECT DISTINCT n, off, length(core) AS len FROM patterns) USING (n)),
found AS (SELECT w.word, p.* FROM cored w JOIN patterns p ON w.n = p.n AND w.off = p.off AND w.core = p.core AND regexp_full_match(w.word, p.rule)),
raw AS (SELECT w.seq_id, w.topology, f.enzyme, f.strand, w.i AS site_start, w.i + f.top AS c, w.i + f.bottom AS b FROM win w JOIN found f ON w.n = f.n AND w.word = f.word),
cuts AS (SELECT seq_id, enzyme, strand, site_start::INT AS site_start, (CASE WHEN topology = 'circular' THEN ((c % 512) + 512) % 512 ELSE c END)::INT AS cut, (CASE WHEN topology = 'circular' THEN ((b % 512) + 512) % 512 ELSE b END)::INT AS cut_bottom FROM raw WHERE topology = 'circular' OR (c BETWEEN 0 AND 512 AND b BETWEEN 0 AND 512))"""
ALU = """hits AS (SELECT seq_id, topology, ((i + 2) % 512)::INT AS cut FROM molecules, range(512) r(i) WHERE substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 3) ELSE sequence END, i + 1, 4) = 'AGCT' AND (topology = 'circular' OR i + 2 BETWEEN 1 AND 511)),
points AS (SELECT DISTINCT * FROM hits UNION ALL SELECT seq_id, topology, unnest([0, 512])::INT FROM molecules WHERE topology = 'linear'),
spans AS (SELECT seq_id, cut AS start, coalesce(lead(cut) OVER w, CASE WHEN topology = 'circular' THEN first(cut) OVER w + 512 END)::INT AS "end" FROM points WINDOW w AS (PARTITION BY seq_id ORDER BY cut)),
frags AS (SELECT seq_id, start, "end", "end" - start AS size FROM spans WHERE "end" IS NOT NULL UNION ALL SELECT seq_id, 0, 512, 512 FROM molecules WHERE topology = 'circular' AND seq_id NOT IN (SELECT seq_id FROM hits))"""


def alu_fragments(spark, sf_dir):
    mol = derive.molecules(spark, sf_dir)
    cuts = scan.cut_sites(mol, dims.enzymes(spark, [e for e in dims.ENZYMES if e[0] == "AluI"]))
    return digest.fragments(mol.select("seq_id", "topology", "length"), cuts.select("seq_id", "cut"), ["seq_id"])


@query(views("molecules", more=ALU) + "SELECT seq_id, count(*) AS n_fragments, max(size)::BIGINT AS longest, sum(size)::BIGINT AS total FROM frags GROUP BY seq_id")
def digest_alui(spark, sf_dir):
    return alu_fragments(spark, sf_dir).groupBy("seq_id").agg(F.count("*").alias("n_fragments"), F.max("size").cast("bigint").alias("longest"), F.sum("size").alias("total"))


@query(views("molecules", more=ALU) + 'SELECT seq_id, start, "end", size FROM frags')
def digest_fragments(spark, sf_dir):
    return alu_fragments(spark, sf_dir)


@query(views("molecules", more=ALU + ", marked AS (SELECT seq_id, size, CASE WHEN lag(size) OVER w IS NULL OR lag(size) OVER w::DOUBLE / size >= 1.15 THEN 1 ELSE 0 END AS new, row_number() OVER w AS r FROM frags WINDOW w AS (PARTITION BY seq_id ORDER BY size DESC, start)), banded AS (SELECT seq_id, size, sum(new) OVER (PARTITION BY seq_id ORDER BY r) AS band FROM marked)") + "SELECT seq_id, band::BIGINT AS band, max(size)::BIGINT AS size, count(*) AS n FROM banded GROUP BY 1, 2")
def gel_bands(spark, sf_dir):
    return digest.gel_bands(alu_fragments(spark, sf_dir), ["seq_id"]).withColumn("size", F.col("size").cast("bigint"))


@query(views("molecules", more=ALU + ", profile AS (SELECT seq_id, count(*) AS n, min(size) AS least, max(size) AS most FROM frags GROUP BY seq_id)") + "SELECT seq_id, n, least::BIGINT AS least FROM profile WHERE n >= 2 ORDER BY least DESC, n DESC, seq_id LIMIT 20")
def diagnostic_topk(spark, sf_dir):
    """The 20 molecules whose smallest fragment is largest: a report."""
    p = alu_fragments(spark, sf_dir).groupBy("seq_id").agg(F.count("*").alias("n"), F.min("size").cast("bigint").alias("least"))
    return p.where("n >= 2").orderBy(F.desc("least"), F.desc("n"), "seq_id").limit(20)


@query(views("molecules", more=ALU + ", k AS (SELECT topology, seq_id, count(*) AS n FROM points JOIN molecules USING (seq_id, topology) GROUP BY 1, 2)") + "SELECT seq_id, (CASE WHEN topology = 'circular' THEN n * n ELSE n * (n - 1) // 2 END)::BIGINT AS n_spans FROM k")
def partial_digest(spark, sf_dir):
    mol = derive.molecules(spark, sf_dir)
    cuts = scan.cut_sites(mol, dims.enzymes(spark, [e for e in dims.ENZYMES if e[0] == "AluI"]))
    return digest.partial_fragments(mol.select("seq_id", "topology", "length"), cuts.select("seq_id", "cut"), ["seq_id"]).groupBy("seq_id").agg(F.count("*").alias("n_spans"))


@query(views("molecules", more=CUTS) + "SELECT seq_id, enzyme, strand, site_start, cut, cut_bottom FROM cuts")
def cut_sites_all(spark, sf_dir):
    return scan.cut_sites(derive.molecules(spark, sf_dir), dims.enzymes(spark))


@query(views("molecules", more=CUTS + ", n AS (SELECT enzyme, count(*) AS sites, count(DISTINCT seq_id) AS mols FROM cuts GROUP BY 1), " + ENZ) + "SELECT enzyme, site, coalesce(sites, 0) AS n_sites, coalesce(mols, 0) AS n_molecules, (SELECT count(*) FROM molecules) - coalesce(mols, 0) AS n_uncut FROM enzymes LEFT JOIN n USING (enzyme)")
def enzyme_summary(spark, sf_dir):
    mol, enz = derive.molecules(spark, sf_dir), dims.enzymes(spark)
    found = scan.cut_sites(mol, enz).groupBy("enzyme").agg(F.count("*").alias("n_sites"), F.countDistinct("seq_id").alias("n_molecules"))
    total = mol.agg(F.count("*").alias("total"))
    out = enz.select(F.col("name").alias("enzyme"), "site").join(found, "enzyme", "left").na.fill(0, ["n_sites", "n_molecules"])
    return out.join(F.broadcast(total)).select("enzyme", "site", "n_sites", "n_molecules", (F.col("total") - F.col("n_molecules")).alias("n_uncut"))


@query("WITH " + ENZ + " SELECT site, count(*) AS n, string_agg(enzyme, ',' ORDER BY enzyme) AS names FROM enzymes GROUP BY site HAVING count(*) > 1")
def isoschizomers(spark, sf_dir):
    g = dims.enzymes(spark).groupBy("site").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return g.where("n > 1")


@query(views("molecules", more="gatc AS (SELECT seq_id, i FROM molecules, range(512) r(i) WHERE substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 5) ELSE sequence END, i + 1, 6) = 'TGATCA' AND (topology = 'circular' OR i <= 506))") + "SELECT m.seq_id, count(g.i) AS blocked FROM molecules m LEFT JOIN gatc g USING (seq_id) GROUP BY 1")
def methyl_blocked(spark, sf_dir):
    """BclI sites, all of which a dam host's GATC methylation blocks."""
    mol = derive.molecules(spark, sf_dir)
    hits = scan.motif(mol, "TGATCA", ["seq_id"])
    return mol.select("seq_id").join(hits, "seq_id", "left").groupBy("seq_id").agg(F.count("start").alias("blocked"))


@query(views("coded", more="s AS (SELECT seq_id, length(sequence) - length(translate(sequence, 'GCS', '')) AS six, length(sequence) - length(translate(sequence, 'RY', '')) AS three, length(sequence) - length(translate(sequence, 'N', '')) AS n FROM coded)") + "SELECT seq_id, (six * 6 + three * 3)::BIGINT AS gc_sixths, ((512 - n) * 6)::BIGINT AS counted_sixths FROM s")
def gc_content(spark, sf_dir):
    gc, counted = S.gc_sixths(F.col("sequence"))
    return derive.molecules(spark, sf_dir, derive.CODES).select("seq_id", gc.cast("bigint").alias("gc_sixths"), counted.cast("bigint").alias("counted_sixths"))


@query(views("coded") + f"SELECT seq_id, {RC.format('sequence')} AS sequence FROM coded")
def revcomp(spark, sf_dir):
    return derive.molecules(spark, sf_dir, derive.CODES).select("seq_id", S.revcomp(F.col("sequence")).alias("sequence"))


SIX = _codons("code") + ", strands AS (SELECT seq_id, 'forward' AS strand, sequence AS s FROM molecules UNION ALL SELECT seq_id, 'reverse', reverse(translate(sequence, 'ACGT', 'TGCA')) FROM molecules), frames AS (SELECT seq_id, strand, f AS frame, k, substr(s, f + 3 * k + 1, 3) AS codon FROM strands, range(3) a(f), range(170) b(k) WHERE f + 3 * k + 3 <= 512)"


@query(views("molecules", more=SIX) + "SELECT seq_id, strand, frame::INT AS frame, string_agg(aa, '' ORDER BY k) AS protein FROM frames JOIN code USING (codon) GROUP BY 1, 2, 3")
def six_frame(spark, sf_dir):
    seq = F.col("sequence")
    frames = F.array(*[F.struct(F.lit(s).alias("strand"), F.lit(f).alias("frame"), S.translate(t, 1, f).alias("protein")) for s, t in (("forward", seq), ("reverse", S.revcomp(seq))) for f in range(3)])
    return derive.molecules(spark, sf_dir).select("seq_id", F.inline(frames))


@query(views("molecules", more=_codons("c2", 2) + ", " + _codons("c11", 11) + ", k AS (SELECT seq_id, k, substr(sequence, 3 * k + 1, 3) AS codon FROM molecules, range(170) b(k))") + "SELECT seq_id, string_agg(c2.aa, '' ORDER BY k) AS mito, string_agg(c11.aa, '' ORDER BY k) AS bacterial FROM k JOIN c2 USING (codon) JOIN c11 USING (codon) GROUP BY 1")
def translate_table(spark, sf_dir):
    return derive.molecules(spark, sf_dir).select("seq_id", S.translate(F.col("sequence"), 2).alias("mito"), S.translate(F.col("sequence"), 11).alias("bacterial"))


@query(views("primers", more="nn(step, h, s) AS (VALUES " + ", ".join(f"('{k}', {round(h * 10)}, {round(s * 10)})" for k, (h, s) in dims.NEAREST.items()) + "), sums AS (SELECT primer_id, any_value(sequence) AS q, sum(h) AS h, sum(s) AS s FROM primers, range(19) r(i) JOIN nn ON nn.step = substr(sequence, i + 1, 2) GROUP BY primer_id), ends AS (SELECT *, h + (CASE WHEN q[1] IN ('G','C') THEN 1 ELSE 23 END) + (CASE WHEN q[20] IN ('G','C') THEN 1 ELSE 23 END) AS hh, s + (CASE WHEN q[1] IN ('G','C') THEN -28 ELSE 41 END) + (CASE WHEN q[20] IN ('G','C') THEN -28 ELSE 41 END) AS ss, q = reverse(translate(q, 'ACGT', 'TGCA')) AS own, (length(q) - length(translate(q, 'GC', ''))) / 20.0::DOUBLE AS gc FROM sums), tm AS (SELECT primer_id, hh * 100.0::DOUBLE / (ss / 10.0::DOUBLE + (CASE WHEN own THEN -1.4 ELSE 0 END) + 0.368::DOUBLE * 19 * ln(0.05::DOUBLE) + 1.987::DOUBLE * (CASE WHEN own THEN ln(500e-9::DOUBLE) ELSE ln(500e-9::DOUBLE / 4) END)) - 273.15 AS tm, 1 / (1 / (hh * 100.0::DOUBLE / (ss / 10.0::DOUBLE + (CASE WHEN own THEN -1.4 ELSE 0 END) + 1.987::DOUBLE * ln(500e-9::DOUBLE))) + ((4.29 * gc - 3.95) * ln(0.15::DOUBLE) + 0.94 * ln(0.15::DOUBLE) * ln(0.15::DOUBLE)) * 1e-5) - 273.15 AS q5 FROM ends)") + "SELECT primer_id, floor(tm * 100 + 0.5)::BIGINT AS tm_hundredths, floor(q5 * 100 + 0.5)::BIGINT AS q5_hundredths FROM tm")
def melting_temperatures(spark, sf_dir):
    hundredths = lambda c: F.floor(c * 100 + 0.5).cast("bigint")
    return derive.primers(spark, sf_dir).select("primer_id", hundredths(S.melting(F.col("sequence"))).alias("tm_hundredths"), hundredths(S.q5_melting(F.col("sequence"))).alias("q5_hundredths"))


@query(views("molecules", more="ch AS (SELECT seq_id, i, substr(sequence, i + 1, 1) AS c FROM molecules, range(512) r(i)), g AS (SELECT seq_id, c, i - row_number() OVER (PARTITION BY seq_id, c ORDER BY i) AS run FROM ch), runs AS (SELECT seq_id, count(*) AS n FROM g GROUP BY seq_id, c, run)") + "SELECT seq_id, max(n)::INT AS longest FROM runs GROUP BY 1")
def homopolymer(spark, sf_dir):
    return derive.molecules(spark, sf_dir).select("seq_id", S.longest_run(F.col("sequence")).alias("longest"))


@query("SELECT doc_id, regexp_replace(text, '[\\s0-9]+', '', 'g') AS letters, regexp_full_match(regexp_replace(text, '[\\s0-9]+', '', 'g'), '[ACGTURYKMBDHVSWNacgturykmbdhvswn]*') AS valid FROM documents")
def validate_normalise(spark, sf_dir):
    letters = S.normalise(F.col("text"))
    return derive.table(spark, sf_dir, "documents").select("doc_id", letters.alias("letters"), S.is_nucleotide(letters).alias("valid"))


@query("SELECT s_suppkey, CASE WHEN regexp_full_match(upper(w), '[ACGTURYKMBDHVSWN]+') THEN 'nucleotide' ELSE 'protein' END AS alphabet FROM (SELECT s_suppkey, translate(md5(s_suppkey::VARCHAR), '0123456789abcdef', CASE WHEN s_suppkey % 2 = 0 THEN 'ACGTACGTACGTRYSN' ELSE 'ACDEFGHIKLMNPQRS' END) AS w FROM supplier)")
def guess_alphabet(spark, sf_dir):
    h = F.md5(F.col("s_suppkey").cast("string"))
    word = F.when(F.col("s_suppkey") % 2 == 0, F.translate(h, "0123456789abcdef", derive.CODES)).otherwise(F.translate(h, "0123456789abcdef", "ACDEFGHIKLMNPQRS"))
    return derive.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(S.is_nucleotide(word), "nucleotide").otherwise("protein").alias("alphabet"))


@query(views("molecules") + "SELECT seq_id, replace(replace(rtrim(to_base64(unhex(sha1(sequence))), '='), '+', '-'), '/', '_') AS seguid FROM molecules")
def seguid_linear(spark, sf_dir):
    return derive.molecules(spark, sf_dir).select("seq_id", S.seguid(F.col("sequence")).alias("seguid"))


@query(views("molecules", more="rot AS (SELECT seq_id, substr(sequence, i + 1) || substr(sequence, 1, i) AS r FROM molecules, range(512) t(i) WHERE topology = 'circular')") + "SELECT seq_id, min(r) AS rotation, sha1(min(r)) AS digest FROM rot GROUP BY 1")
def min_rotation(spark, sf_dir):
    circles = derive.molecules(spark, sf_dir).where("topology = 'circular'")
    return circles.select("seq_id", S.minimal_rotation(F.col("sequence")).alias("rotation")).withColumn("digest", F.sha1("rotation"))


MOTIF = S.iupac_class("GTYRAC"), S.iupac_class("GGNNC"), S.iupac_class("GNNCC")


@query(views("molecules", more="win AS (SELECT seq_id, i, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 4) ELSE sequence END, i + 1, 5) AS w FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= 507)") + f"SELECT seq_id, i::INT AS start, 'forward' AS strand FROM win WHERE regexp_full_match(w, '{MOTIF[1]}') UNION ALL SELECT seq_id, i::INT, 'reverse' FROM win WHERE regexp_full_match(w, '{MOTIF[2]}')")
def motif_both_strands(spark, sf_dir):
    return scan.motif(derive.molecules(spark, sf_dir), "GGNNC", ["seq_id"])


ORF_SQL = "strands AS (SELECT seq_id, topology, 'forward' AS strand, sequence AS s FROM molecules UNION ALL SELECT seq_id, topology, 'reverse', reverse(translate(sequence, 'ACGT', 'TGCA')) FROM molecules), c AS (SELECT seq_id, topology, strand, i::INT AS p, substr(CASE WHEN topology = 'circular' THEN s || substr(s, 1, 2) ELSE s END, i + 1, 3) AS w FROM strands, range(512) t(i) WHERE topology = 'circular' OR i <= 509), m AS (SELECT *, w <> 'ATG' AS stop FROM c WHERE w IN ('ATG', 'TAA', 'TAG', 'TGA'))"


@query(views("molecules", more=ORF_SQL + ", l AS (SELECT *, p % 3 AS frame, coalesce(sum(stop::INT) OVER (PARTITION BY seq_id, strand, p % 3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m WHERE topology = 'linear'), g AS (SELECT seq_id, strand, frame, min(p) FILTER (NOT stop) AS start, max(p) FILTER (stop) + 3 AS e FROM l GROUP BY seq_id, strand, frame, run)") + 'SELECT seq_id, strand, frame, start, e AS "end" FROM g WHERE start IS NOT NULL AND e IS NOT NULL AND (e - start) / 3 - 1 >= 20')
def orfs_linear(spark, sf_dir):
    return orf.linear_orfs(derive.molecules(spark, sf_dir), 20)


@query(views("molecules", more=ORF_SQL + ", pairs AS (SELECT q.seq_id, q.strand, q.p AS q, a.stop, ((q.p - a.p) % 512 + 512) % 512 AS back FROM m q JOIN m a ON q.seq_id = a.seq_id AND q.strand = a.strand WHERE q.stop AND q.topology = 'circular'), ok AS (SELECT * FROM pairs WHERE back % 3 = 0 AND back >= 3 AND back + 3 <= 512), wall AS (SELECT seq_id, strand, q, min(back) AS wall FROM ok WHERE stop GROUP BY 1, 2, 3), best AS (SELECT o.seq_id, o.strand, o.q, max(o.back) AS back FROM ok o LEFT JOIN wall USING (seq_id, strand, q) WHERE NOT o.stop AND (wall IS NULL OR o.back < wall) GROUP BY 1, 2, 3)") + 'SELECT seq_id, strand, (((q - back) % 512 + 512) % 512) % 3 AS frame, ((q - back) % 512 + 512) % 512 AS start, ((q - back) % 512 + 512) % 512 + back + 3 AS "end" FROM best WHERE back / 3 >= 20')
def orfs_circular(spark, sf_dir):
    return orf.circular_orfs(derive.molecules(spark, sf_dir), 20)


@query(views("molecules", more="gc AS (SELECT seq_id, topology, i, (substr(sequence, i + 1, 1) IN ('G', 'C'))::INT AS g FROM molecules, range(512) t(i)), lines AS (SELECT seq_id, i, sum(g) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND 25 FOLLOWING) AS s, count(*) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND 25 FOLLOWING) AS n FROM gc WHERE topology = 'linear')") + "SELECT seq_id, i::INT AS pos, s::BIGINT AS gc, n::BIGINT AS bases FROM lines")
def gc_window(spark, sf_dir):
    """GC in a window of 50 around each base of a line; an even window leans one base to the left."""
    rows = derive.molecules(spark, sf_dir).where("topology = 'linear'").select("seq_id", F.posexplode(F.split("sequence", "")).alias("pos", "base")).where("base <> ''")
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(-24, 25)
    return rows.select("seq_id", "pos", F.sum(F.col("base").isin("G", "C").cast("bigint")).over(w).alias("gc"), F.count("*").over(w).alias("bases"))


KM = "k AS (SELECT DISTINCT seq_id, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 7) ELSE sequence END, i + 1, 8) AS kmer FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= 504)"


@query(views("molecules", more=KM + ", pairs AS (SELECT a.seq_id AS x, b.seq_id AS y, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND b.seq_id = a.seq_id + 1 GROUP BY 1, 2), n AS (SELECT seq_id, count(*) AS n FROM k GROUP BY 1)") + "SELECT x, y, shared, (a.n + b.n - shared)::BIGINT AS together FROM pairs JOIN n a ON a.seq_id = x JOIN n b ON b.seq_id = y")
def kmer_distance(spark, sf_dir):
    """Shared and united 8-mers of each molecule and the next."""
    k = scan.kmer_sets(derive.molecules(spark, sf_dir), 8)
    x, y = k.select(F.col("seq_id").alias("x"), F.col("kmers").alias("kx"), (F.col("seq_id") + 1).alias("y")), k.select(F.col("seq_id").alias("y"), F.col("kmers").alias("ky"))
    shared = F.size(F.array_intersect("kx", "ky")).cast("bigint")
    out = x.join(y, "y").select("x", "y", shared.alias("shared"), (F.size("kx") + F.size("ky")).cast("bigint").alias("both")).where("shared > 0")
    return out.select("x", "y", "shared", (F.col("both") - F.col("shared")).alias("together"))


@query(views("molecules", more=KM) + "SELECT kmer, count(*) AS n FROM k WHERE seq_id % 2 = 0 AND kmer IN (SELECT kmer FROM k WHERE seq_id % 2 = 1) AND kmer NOT IN (SELECT kmer FROM k WHERE seq_id % 50 = 1) GROUP BY 1")
def set_ops_kmers(spark, sf_dir):
    k = scan.kmers(derive.molecules(spark, sf_dir), 8)
    odd, some = k.where("seq_id % 2 = 1").select("kmer").distinct(), k.where("seq_id % 50 = 1").select("kmer").distinct()
    return k.where("seq_id % 2 = 0").join(odd, "kmer", "left_semi").join(some, "kmer", "left_anti").groupBy("kmer").agg(F.count("*").alias("n"))


GUIDES = "win AS (SELECT seq_id, topology, i, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 22) ELSE sequence END, i + 1, 23) AS w FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= 489), both_ways AS (SELECT seq_id, topology, 'forward' AS strand, i AS start, w FROM win UNION ALL SELECT seq_id, topology, 'reverse', i + 3, reverse(translate(w, 'ACGT', 'TGCA')) FROM win), guides AS (SELECT seq_id, strand, (CASE WHEN topology = 'circular' THEN start % 512 ELSE start END)::INT AS start, substr(w, 1, 20) AS spacer, substr(w, 21, 3) AS pam FROM both_ways WHERE substr(w, 22, 2) = 'GG')"


@query(views("molecules", more=GUIDES) + "SELECT seq_id, strand, start, spacer, pam, (length(spacer) - length(translate(spacer, 'GC', '')))::INT AS gc FROM guides")
def crispr_guides(spark, sf_dir):
    return scan.guides(derive.molecules(spark, sf_dir))


#: Distinct spacers of the guides and the pairs of them within three mismatches: one of four pieces of five is equal.
NEAR = "u AS (SELECT spacer, count(*) AS copies FROM guides GROUP BY 1), near AS (" + " UNION ".join(f"SELECT a.spacer, b.spacer AS other, b.copies FROM u a JOIN u b ON substr(a.spacer, {k * 5 + 1}, 5) = substr(b.spacer, {k * 5 + 1}, 5) AND hamming(a.spacer, b.spacer) <= 3" for k in range(4)) + ")"


@query(views("molecules", more=GUIDES + ", " + NEAR) + "SELECT spacer, sum(copies)::BIGINT AS n FROM near GROUP BY 1")
def crispr_offtargets(spark, sf_dir):
    g = scan.guides(derive.molecules(spark, sf_dir))
    return scan.off_targets(g, g, 3)


@query("SELECT sequence, count(*) AS copies, min(id) AS first_id FROM (SELECT doc_id AS id, sha1(text) AS sequence FROM documents) GROUP BY 1")
def dedup_checksum(spark, sf_dir):
    d = derive.table(spark, sf_dir, "documents").select(F.sha1("text").alias("sequence"), "doc_id")
    return d.groupBy("sequence").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
