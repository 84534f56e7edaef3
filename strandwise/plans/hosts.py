"""Host methylation, base and prime editing, nickase pairs, guides of other nucleases."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise import derive, dims
from strandwise.derive import with_views as views
from strandwise.functions.seq import iupac_class
from strandwise.operators import editing, methylation, scan
from strandwise.plans.registry import query
from strandwise.plans.sequence import CUTS, ENZ, GUIDES

_list = lambda x: "[" + ", ".join(map(str, x)) + "]::BIGINT[]"
_CONF = ", ".join(f"('{e}', '{k}', {_list(t)}, {_list(b)})" for e, kinds in dims.METHYL_CONFIGURATIONS.items() for k, listed in kinds.items() for t, b in listed)
_ANY = ", ".join(f"('{e}', '{k}')" for e, kinds in dims.METHYL_ANY.items() for k in kinds)
METHYL = (
    CUTS + ", " + ENZ + f", conf(enzyme, kind, ct, cb) AS (VALUES {_CONF}), anyof(enzyme, kind) AS (VALUES {_ANY}),"
    " meth AS (SELECT seq_id, kind, side, CASE WHEN topology = 'circular' THEN (i + k) % 512 ELSE i + k END AS p FROM (SELECT seq_id, topology, i, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, 4) ELSE sequence END, i + 1, 5) AS w FROM molecules, range(512) r(i)) x,"
    " (VALUES ('Dam', 0, 1, 4, 'GATC'), ('Dam', 1, 2, 4, 'GATC'), ('Dcm', 0, 1, 5, 'CC[AT]GG'), ('Dcm', 1, 3, 5, 'CC[AT]GG')) v(kind, side, k, n, rule) WHERE length(w) >= n AND regexp_full_match(substr(w, 1, n), rule)),"
    " site AS (SELECT c.seq_id, c.enzyme, c.strand, c.site_start, length(e.site) AS n, e.site = reverse(translate(e.site, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS pal FROM cuts c JOIN enzymes e USING (enzyme)),"
    " inside AS (SELECT s.*, m.kind, m.side, CASE WHEN s.strand = 'reverse' THEN n - 1 - off ELSE off END AS o, CASE WHEN s.strand = 'reverse' THEN 1 - m.side ELSE m.side END AS face FROM (SELECT site.*, topology FROM site JOIN molecules USING (seq_id)) s JOIN meth m USING (seq_id), LATERAL (SELECT CASE WHEN s.topology = 'circular' THEN (m.p - s.site_start + 512) % 512 ELSE m.p - s.site_start END AS off) WHERE off BETWEEN 0 AND n - 1),"
    " sets AS (SELECT seq_id, enzyme, strand, site_start, kind, any_value(n) AS n, any_value(pal) AS pal, coalesce(list(DISTINCT o::BIGINT) FILTER (face = 0), []) AS t, coalesce(list(DISTINCT o::BIGINT) FILTER (face = 1), []) AS b FROM inside GROUP BY 1, 2, 3, 4, 5),"
    " blocked AS (SELECT DISTINCT s.seq_id, s.enzyme, s.strand, s.site_start, s.kind FROM sets s JOIN conf c USING (enzyme, kind) WHERE (list_has_all(t, ct) AND list_has_all(b, cb)) OR (pal AND list_has_all([n - 1 - x FOR x IN b], ct) AND list_has_all([n - 1 - x FOR x IN t], cb))"
    " UNION SELECT s.seq_id, s.enzyme, s.strand, s.site_start, s.kind FROM sets s JOIN anyof USING (enzyme, kind))"
)


@query(views("molecules", more=METHYL) + "SELECT * FROM blocked")
def methylation_blocked(spark, sf_dir):
    """Cut sites that a dam+ dcm+ host's methylation blocks or impairs, and by which methylase."""
    return methylation.blocked_sites(derive.molecules(spark, sf_dir), dims.enzymes(spark))


@query(views("molecules", more=METHYL) + "SELECT c.seq_id, count(*) AS n_sites, count(*) FILTER (b.seq_id IS NULL) AS n_cut FROM cuts c LEFT JOIN (SELECT DISTINCT seq_id, enzyme, strand, site_start FROM blocked WHERE kind = 'Dam') b USING (seq_id, enzyme, strand, site_start) GROUP BY 1")
def host_cuttable(spark, sf_dir):
    """Sites of every molecule, and those left to cut in DNA of a dam+ dcm- strain."""
    mol, enz = derive.molecules(spark, sf_dir), dims.enzymes(spark)
    cut = methylation.cuttable_sites(mol, enz, dcm=False).groupBy("seq_id").agg(F.count("*").alias("n_cut"))
    return scan.cut_sites(mol, enz).groupBy("seq_id").agg(F.count("*").alias("n_sites")).join(cut, "seq_id", "left").na.fill(0, ["n_cut"])


def _nuclease_sql(pam: str, spacer: int, first: bool) -> str:
    n = spacer + len(pam)
    rule = iupac_class(pam) + f"[ACGT]{{{spacer}}}" if first else f"[ACGT]{{{spacer}}}" + iupac_class(pam)
    low, beside, own = (len(pam) + 1, 1, len(pam)) if first else (1, spacer + 1, 0)
    return (
        f"win AS (SELECT seq_id, topology, i, substr(CASE WHEN topology = 'circular' THEN sequence || substr(sequence, 1, {n - 1}) ELSE sequence END, i + 1, {n}) AS w FROM molecules, range(512) t(i) WHERE topology = 'circular' OR i <= {512 - n}),"
        f" ways AS (SELECT seq_id, topology, 'forward' AS strand, i + {own} AS start, w FROM win UNION ALL SELECT seq_id, topology, 'reverse', i + {n - spacer - own}, reverse(translate(w, 'ACGT', 'TGCA')) FROM win)"
        f" SELECT seq_id, strand, (CASE WHEN topology = 'circular' THEN start % 512 ELSE start END)::INT AS start, substr(w, {low}, {spacer}) AS spacer, substr(w, {beside}, {len(pam)}) AS pam FROM ways WHERE regexp_full_match(w, '{rule}')"
    )


def _guides(spark, sf_dir, name):
    _, pam, side, spacer, *_ = next(n for n in dims.NUCLEASES if n[0] == name)
    return scan.guides(derive.molecules(spark, sf_dir), pam, spacer, side == "5prime").drop("gc")


@query(views("molecules", more=_nuclease_sql("NNGRRT", 21, False)))
def guides_sacas9(spark, sf_dir):
    return _guides(spark, sf_dir, "SaCas9")


@query(views("molecules", more=_nuclease_sql("TTTV", 23, True)))
def guides_cas12a(spark, sf_dir):
    """Guides whose PAM stands before the spacer."""
    return _guides(spark, sf_dir, "AsCas12a")


_EDITORS = "editors(editor, base, becomes, low, high) AS (VALUES " + ", ".join(f"('{n}', '{a}', '{b}', {x}, {y})" for n, a, b, x, y in dims.BASE_EDITORS) + ")"


@query(views("molecules", more=GUIDES + ", " + _EDITORS + ", e AS (SELECT g.*, e.*, substr(spacer, low, high - low + 1) AS w FROM guides g, editors e)") + "SELECT seq_id, strand, start, editor, (length(w) - length(replace(w, base, '')))::INT AS n_editable, (instr(w, base) + low - 1)::INT AS first, substr(spacer, 1, low - 1) || replace(w, base, becomes) || substr(spacer, high + 1) AS edited FROM e WHERE contains(w, base)")
def base_editing(spark, sf_dir):
    g = scan.guides(derive.molecules(spark, sf_dir))
    return editing.base_edits(g).select("seq_id", "strand", "start", "editor", "n_editable", "first", "edited")


@query(views("molecules", more=GUIDES + ", n AS (SELECT g.seq_id, m.topology, g.strand, CASE WHEN g.strand = 'forward' THEN g.start + 17 ELSE g.start + 3 END AS c FROM guides g JOIN molecules m USING (seq_id) WHERE g.seq_id % 10 = 0), p AS (SELECT DISTINCT a.seq_id, CASE WHEN a.topology = 'circular' THEN a.c % 512 ELSE a.c END AS f, CASE WHEN a.topology = 'circular' THEN b.c % 512 ELSE b.c END AS r, CASE WHEN a.topology = 'circular' THEN ((b.c - a.c + 256) % 512 + 512) % 512 - 256 ELSE b.c - a.c END AS o FROM n a JOIN n b ON a.seq_id = b.seq_id AND a.strand = 'reverse' AND b.strand = 'forward')").replace(" WHERE g.seq_id % 10 = 0", "") + "SELECT seq_id, f::INT AS forward_nick, r::INT AS reverse_nick, CASE WHEN o > 0 THEN '5prime' WHEN o < 0 THEN '3prime' ELSE 'blunt' END AS overhang, abs(o)::INT AS size FROM p WHERE abs(o) <= 100")
def nickase_pairs(spark, sf_dir):
    mol = derive.molecules(spark, sf_dir)
    g = editing.cut_points(scan.guides(mol), 17, 17).join(mol.select("seq_id", "topology", "length"), "seq_id")
    return editing.nick_pairs(g)


PRIME = "q AS (SELECT seq_id, seq_id % 7 AS edit_id, 150 + seq_id % 200 AS a, seq_id % 4 AS d, substr('GATTACA', 1, 1 + seq_id % 5) AS ins, sequence FROM molecules WHERE topology = 'linear'), s AS (SELECT q.*, g.strand, CASE WHEN g.strand = 'forward' THEN sequence ELSE reverse(translate(sequence, 'ACGT', 'TGCA')) END AS t, CASE WHEN g.strand = 'forward' THEN g.start + 17 ELSE 512 - g.start - 3 END AS cut, CASE WHEN g.strand = 'forward' THEN a ELSE 512 - a - d END AS f, CASE WHEN g.strand = 'forward' THEN ins ELSE reverse(translate(ins, 'ACGT', 'TGCA')) END AS n FROM q JOIN guides g USING (seq_id)), e AS (SELECT *, f - cut AS dist, substr(t, 1, f) || n || substr(t, f + d + 1) AS mutant FROM s WHERE f - cut BETWEEN 0 AND 30 AND cut >= 13 AND f + d + 10 <= 512)"


@query(views("molecules", more=GUIDES + ", " + PRIME) + "SELECT seq_id, edit_id, strand, (CASE WHEN strand = 'forward' THEN cut ELSE 512 - cut END)::INT AS nick, dist::INT AS distance, reverse(translate(substr(t, cut - 12, 13), 'ACGT', 'TGCA')) AS pbs, reverse(translate(substr(mutant, cut + 1, dist + length(n) + 10), 'ACGT', 'TGCA')) AS rtt, dist < 6 AND substr(mutant, cut + 4, 3) <> substr(t, cut + 4, 3) AS disrupts_pam FROM e WHERE dist + length(n) + 10 <= 60")
def prime_editing(spark, sf_dir):
    """pegRNAs for one small edit of every line."""
    mol = derive.molecules(spark, sf_dir).where("topology = 'linear'")
    k = F.col("seq_id")
    edits = mol.select("seq_id", (k % 7).alias("edit_id"), (150 + k % 200).cast("int").alias("at"), (k % 4).cast("int").alias("deleted"), F.substring(F.lit("GATTACA"), F.lit(1), (1 + k % 5).cast("int")).alias("inserted"))
    g = scan.guides(mol).join(mol.select("seq_id", "sequence"), "seq_id")
    return editing.prime_edits(g, edits)
