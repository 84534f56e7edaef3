"""Operators against brute force: scans of long circles, reading frames, primers, scripts, assemblies."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.functions.seq import least_rotation
from strandwise.operators import align, anneal, design, detect, ends, history, orf, primer_design, protein, scan, script, verify

MOL = "seq_id bigint, topology string, length int, sequence string"


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, len(s or ""), s) for k, t, s in rows], MOL)


def matches(text, circular, pattern):
    n, size = len(text), len(pattern)
    if size > n:
        return set()
    up = (text + text[: size - 1] if circular else text).upper().replace("U", "T")
    sets = [set(dims.IUPAC[c]) for c in pattern]
    return {i for i in range(n if circular else n - size + 1) if all(c in dims.IUPAC and set(dims.IUPAC[c]) <= s for c, s in zip(up[i : i + size], sets, strict=True))}


def test_scan_brute(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(1, "circular", dna(rng, 700)), (2, "linear", dna(rng, 700, "ACGTRYNacgtU-")), (3, "circular", "GAATTC"), (4, "circular", "GA"), (5, "linear", ""), (6, "linear", None), (7, "circular", dna(rng, 90, "AG"))]
    df = frame(spark, rows).repartition(2)
    for pattern in ("GAATTC", "GGNNC", "RAATTY", "NNNNNNNGG", "A", "CCWGG"):
        found = {(r.seq_id, r.start, r.strand) for r in scan.motif(df, pattern, ["seq_id"]).collect()}
        want = {(k, i, "forward") for k, t, s in rows for i in matches(s or "", t == "circular", pattern)}
        if dims.revcomp(pattern) != pattern:
            want |= {(k, i, "reverse") for k, t, s in rows for i in matches(s or "", t == "circular", dims.revcomp(pattern))}
        assert found == want, pattern
    words = {(r.seq_id, r.pos, r.word) for r in scan.windows(df, 5, ["seq_id"]).collect()}
    assert words == {(k, i, ((s + s) if t == "circular" else s)[i : i + 5]) for k, t, s in rows if s and len(s) >= 5 for i in range(len(s) if t == "circular" else len(s) - 4)}


def test_scan_of_long_molecules(spark):
    """Pieces and their overlaps, on a circle of 5 Mb and a line."""
    rng = random.Random(2)
    block = dna(rng, 50_000)
    text = (block * 100)[:4_999_999]
    df = frame(spark, [(1, "circular", text), (2, "linear", text)])
    found = Counter((r.seq_id, r.enzyme) for r in scan.cut_sites(df, dims.enzymes(spark, [e for e in dims.ENZYMES if e[0] in ("EcoRI", "NotI", "AluI")])).collect())
    for name in ("EcoRI", "NotI", "AluI"):
        site = next(e[1] for e in dims.ENZYMES if e[0] == name)
        n = sum(text.startswith(site, i) for i in (k for k in range(len(text)) if text[k] == site[0]))
        circle = text + text[: len(site) - 1]
        wrap = sum(circle.startswith(site, i) for i in range(len(text) - len(site) + 1, len(text)))
        assert found[2, name] == n and found[1, name] == n + wrap


def brute_orfs(text, circular, least):
    n, out = len(text), set()
    for strand, s in (("forward", text), ("reverse", dims.revcomp(text))):
        if not circular:
            for f in range(3):
                start = None
                for p in range(f, n - 2, 3):
                    c = s[p : p + 3]
                    if c == "ATG" and start is None:
                        start = p
                    if c in ("TAA", "TAG", "TGA"):
                        if start is not None and (p - start) // 3 >= least:
                            out.add((strand, start % 3, start, p + 3))
                        start = None
            continue
        codon = lambda p, s=s: (s + s)[p % n : p % n + 3]
        for q in range(n):
            if codon(q) in ("TAA", "TAG", "TGA"):
                best = None
                for back in range(3, n - 2, 3):
                    c = codon(q - back)
                    if c in ("TAA", "TAG", "TGA"):
                        break
                    if c == "ATG":
                        best = back
                if best is not None and best // 3 >= least:
                    start = (q - best) % n
                    out.add((strand, start % 3, start, start + best + 3))
    return out


def test_orfs_brute(spark):
    rng = random.Random(3)
    rows = [(k, ("linear", "circular")[k % 2], dna(rng, rng.randrange(0, 260))) for k in range(60)] + [(100, "circular", "ATG" + "AAA" * 20), (101, "circular", "ATGTAA"), (102, "circular", "TAAATG"), (103, "linear", "ATGNNNTAA")]
    found = {}
    for r in orf.orfs(frame(spark, rows).repartition(3), 2).collect():
        found.setdefault(r.seq_id, set()).add((r.strand, r.frame, r.start, r.end))
    for k, t, s in rows:
        want = brute_orfs(s, t == "circular", 2) if len(s) >= (6 if t == "circular" else 3) else set()
        assert found.get(k, set()) == want, (k, t, s)


def test_annealing_brute(spark):
    rng = random.Random(4)
    rows = [(k, ("linear", "circular")[k % 2], dna(rng, 300)) for k in range(8)]
    oligos = []
    for k, (_, _, s) in enumerate(rows):
        for j in range(6):
            at, size = rng.randrange(0, 270), rng.choice((18, 20, 24))
            o = list((s + s)[at : at + size])
            for _ in range(j % 4):
                o[rng.randrange(0, size - 5)] = rng.choice("ACGT")
            o = "".join(o)
            oligos.append((100 * k + j, dims.revcomp(o) if j % 2 else o))
    oligos += [(9000, "ACGTN" * 4), (9001, "ACG")]
    primers = spark.createDataFrame(oligos, "primer_id bigint, sequence string")
    found = {(r.primer_id, r.seq_id, r.strand, r.start, r.mismatches) for r in anneal.anneal_sites(frame(spark, rows), primers).collect()}
    want = set()
    for i, o in oligos:
        if set(o) <= set("ACGT") and len(o) >= 8:
            for k, t, s in rows:
                for p in range(len(s) if t == "circular" else len(s) - len(o) + 1):
                    w = (s + s)[p : p + len(o)]
                    for strand, x in (("forward", w), ("reverse", dims.revcomp(w))):
                        apart = sum(a != b for a, b in zip(x, o, strict=True))
                        if x[-5:] == o[-5:] and apart <= 2:
                            want.add((i, k, strand, p, apart))
    assert found == want and len(found) > 20


def test_amplicons(spark):
    sites = [(1, "linear", 300, 1, "forward", 10, 20, 0), (1, "linear", 300, 2, "reverse", 100, 20, 1), (1, "linear", 300, 2, "reverse", 5, 20, 0), (2, "circular", 300, 1, "forward", 250, 20, 0), (2, "circular", 300, 2, "reverse", 30, 18, 0)]
    df = spark.createDataFrame(sites, "seq_id int, topology string, length int, primer_id int, strand string, start int, size int, mismatches int")
    found = {(r.seq_id, r.start, r.size, r.mismatches) for r in anneal.amplicons(df).collect()}
    assert found == {(1, 10, 110, 1), (2, 250, 98, 0)}
    assert anneal.amplicons(df, reach=100).count() == 1


def test_least_rotation():
    rng = random.Random(5)
    for _ in range(400):
        s = dna(rng, rng.randrange(0, 14), "AB")
        assert least_rotation(s) == min((s[k:] + s[:k] for k in range(len(s))), default="")
    assert least_rotation("A" * 300_000) == "A" * 300_000


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_edit_scripts_are_shortest():
    rng = random.Random(6)
    for _ in range(300):
        a, b = dna(rng, rng.randrange(0, 30), "AC"), dna(rng, rng.randrange(0, 30), "AC")
        out, at, cost = "", 0, 0
        for s, e, t, u in script.shortest_script(a, b):
            out += a[at:s]
            assert len(out) == t
            out, at, cost = out + b[t:u], e, cost + e - s + u - t
        assert out + a[at:] == b and cost == len(a) + len(b) - 2 * common(a, b)


def test_primer_design_brute():
    rng = random.Random(7)
    text = dna(rng, 260)
    found = primer_design.pairs_for(text, 120, 150, region=60)

    def melting(o):
        h = sum(round(dims.NEAREST[o[k : k + 2]][0] * 10) for k in range(len(o) - 1)) + sum(round((dims.INIT_GC if e in "GC" else dims.INIT_AT)[0] * 10) for e in (o[0], o[-1]))
        s = sum(round(dims.NEAREST[o[k : k + 2]][1] * 10) for k in range(len(o) - 1)) + sum(round((dims.INIT_GC if e in "GC" else dims.INIT_AT)[1] * 10) for e in (o[0], o[-1]))
        import math

        own = o == dims.revcomp(o)
        return h * 100 / (s / 10 + (dims.SYMMETRY_S if own else 0) + 0.368 * (len(o) - 1) * math.log(dims.SODIUM_MM / 1000) + dims.GAS * math.log(dims.OLIGO_NM * 1e-9 / (1 if own else 4))) - 273.15

    def good(side):
        out = []
        for a in range(len(side)):
            for n in range(18, 28):
                o = side[a : a + n]
                if len(o) < n or any(c * 5 in o for c in "ACGT"):
                    continue
                gc, t = sum(c in "GC" for c in o) / n, melting(o)
                if 0.35 <= gc <= 0.65 and 55 <= t <= 65:
                    own = max([k for k in range(n + 1) if dims.revcomp(o[n - k :]) in o])
                    out.append((abs(t - 60) + abs(n - 21) + abs(gc - 0.5) + (0 if o[-1] in "GC" else 0.3) + 0.03 * own, o))
        return sorted(out)[:40]

    forward, reverse = good(text[60:120]), good(dims.revcomp(text[150:210]))
    assert [p[0] for p in found] and {f[0] for f in found} <= {o for _, o in forward} and {f[1] for f in found} <= {o for _, o in reverse}
    best = min(pf + pr + 0.25 * abs(melting(f) - melting(r)) + 0.03 * max(primer_design.tail_pairs(f, r), primer_design.tail_pairs(r, f)) for pf, f in forward for pr, r in reverse if abs(melting(f) - melting(r)) <= 3)
    assert abs(found[0][7] - best) < 1e-9
    for f, r, a, b, product, tf, *_ in found:
        assert text[a : a + len(f)] == f and dims.revcomp(text[b : b + len(r)]) == r and product == b + len(r) - a and abs(tf - melting(f)) < 1e-9


def test_parts_brute(spark):
    rng = random.Random(8)
    rows = [(k, ("linear", "circular")[k % 2], dna(rng, 200)) for k in range(6)]
    parts = []
    for k, (_, _, s) in enumerate(rows):
        p = list((s + s)[170:220] if k % 2 else s[20:70])
        for x in rng.sample(range(50), k % 5):
            p[x] = "ACGT"["ACGT".index(p[x]) - 1]
        parts.append((k, dims.revcomp("".join(p)) if k > 3 else "".join(p)))
    found = {(r.seq_id, r.part_id, r.strand, r.start, r.mismatches) for r in detect.seeded_hits(frame(spark, rows), spark.createDataFrame(parts, "part_id bigint, sequence string"), 3).collect()}
    want = set()
    for i, p in parts:
        for strand, x in (("forward", p), ("reverse", dims.revcomp(p))):
            for k, t, s in rows:
                for at in range(200 if t == "circular" else 200 - len(x) + 1):
                    apart = sum(a != b for a, b in zip((s + s)[at : at + len(x)], x, strict=True))
                    if apart <= 3:
                        want.add((k, i, strand, at, apart))
    assert found == want and len(found) >= 4


def test_best_hits_stay(spark):
    rows = [(1, 1, "a", 500, "forward", 0, 100, 0), (1, 2, "a", 500, "forward", 5, 100, 3), (1, 3, "b", 500, "forward", 5, 100, 3), (1, 4, "a", 500, "reverse", 5, 100, 3), (1, 5, "a", 500, "forward", 95, 195, 0), (2, 6, "a", 500, "forward", 480, 580, 0), (2, 7, "a", 500, "forward", 0, 60, 0)]
    df = spark.createDataFrame(rows, "seq_id bigint, part_id bigint, type string, length int, strand string, start bigint, `end` bigint, mismatches int")
    assert {r.part_id for r in detect.keep_best(df).collect()} == {1, 3, 4, 5, 6}


def test_terminal_overlap():
    rng = random.Random(9)
    for _ in range(300):
        a, b = dna(rng, rng.randrange(0, 25), "AC"), dna(rng, rng.randrange(0, 25), "AC")
        least = rng.randrange(1, 6)
        want = max([k for k in range(least, min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k]], default=0)
        assert ends.terminal_overlap(a, b, least) == want


def test_golden_gate_problems():
    pieces = [(1, "AATG", "GGCT", "AATGCCC"), (2, "GGCT", "TTAC", "GGCTAAA"), (3, "TTAC", "AATG", "TTACGGG")]
    assert ends.golden_gate(pieces) == ([(1, False), (2, False), (3, False)], "AATGCCCGGCTAAATTACGGG", "")
    assert ends.golden_gate(pieces[:2])[2] == "the ends do not close"
    assert ends.golden_gate([*pieces, (4, "GGCT", "TTAC", "GGCTTTT")])[2] == "more than one fits"
    assert ends.golden_gate([])[2] == "no pieces"


def test_undo_steps_cap_and_pause(spark):
    rows = [(1, 100 * k, k, "insert", k, 1) for k in range(130)] + [(1, 20_000, 200, "insert", 130, 1), (1, 20_100, 201, "replace", 131, 1), (1, 20_200, 202, None, 131, 1), (2, 0, 1, "delete", 5, 1), (2, 2000, 2, "delete", 5, 1), (2, 4001, 3, "delete", 5, 1)]
    df = spark.createDataFrame(rows, "doc_id int, ms bigint, event_id bigint, op string, position int, len int").repartition(3)
    found = Counter((r.doc_id, r.step) for r in history.undo_steps(df).collect())
    assert found == {(1, 1): 60, (1, 2): 60, (1, 3): 10, (1, 4): 1, (1, 5): 1, (1, 6): 1, (2, 1): 2, (2, 2): 1}


@pytest.mark.parametrize("pam,first", [("NGG", False), ("TTTV", True)])
def test_guides_brute(spark, pam, first):
    rng = random.Random(10)
    rows = [(1, "circular", dna(rng, 200)), (2, "linear", dna(rng, 200, "ACGTN"))]
    size, n = 12, 12 + len(pam)
    want = set()
    for k, t, s in rows:
        for i in range(200 if t == "circular" else 200 - n + 1):
            w = (s + s)[i : i + n]
            for strand, x in (("forward", w), ("reverse", dims.revcomp(w))):
                p, sp = (x[: len(pam)], x[len(pam) :]) if first else (x[size:], x[:size])
                if set(sp) <= set("ACGT") and 0 in matches(p, False, pam):
                    low = i + (len(pam) if (strand == "forward") == first else 0)
                    want.add((k, strand, low % 200 if t == "circular" else low, sp, p))
    found = {(r.seq_id, r.strand, r.start, r.spacer, r.pam) for r in scan.guides(frame(spark, rows), pam, size, first).collect()}
    assert found == want
    assert scan.guides(frame(spark, rows), pam, size, first).where(F.col("gc") != F.length("spacer") - F.length(F.translate("spacer", "GC", ""))).count() == 0


def test_isoelectric_point_brute(spark):
    rng = random.Random(11)
    chains = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(1, 60))) for _ in range(12)] + ["K", "D", "M*", ""]

    def charge(p, ph):
        up = lambda pk: 10**pk / (10**pk + 10**ph)
        total = up(dims.N_TERMINAL_PK.get(p[0], dims.N_TERMINAL_DEFAULT)) - (1 - up(dims.C_TERMINAL_PK))
        return total + sum(up(dims.POSITIVE_PK[c]) for c in p if c in dims.POSITIVE_PK) - sum(1 - up(dims.NEGATIVE_PK[c]) for c in p if c in dims.NEGATIVE_PK)

    df = spark.createDataFrame(list(enumerate(chains)), "k int, p string").select("k", protein.isoelectric_point(F.col("p")).alias("pi"), protein.molecular_weight(F.col("p")).alias("w"))
    for r in df.collect():
        p = chains[r.k].replace("*", "")
        if not p:
            assert r.pi is None and r.w == 0
            continue
        best = min((abs(charge(p, x / 1000)), x / 1000) for x in range(14001))[1]
        assert abs(r.pi - best) < 2e-3
        assert abs(r.w - (sum(dims.RESIDUE_MASS[c] for c in p) + dims.WATER)) < 1e-3


def test_dimer_brute():
    rng = random.Random(12)
    for _ in range(60):
        a, b = dna(rng, rng.randrange(4, 14)), dna(rng, rng.randrange(4, 14))
        best = 0.0
        for i in range(len(a)):  # every stretch of a that pairs with one of b, and can't be longer
            for j in range(i + 2, len(a) + 1):
                part = a[i:j]
                for k in range(len(b) - len(part) + 1):
                    if dims.revcomp(b[k : k + len(part)]) != part:
                        continue
                    before = i > 0 and k + len(part) < len(b) and dims.complement(b[k + len(part)]) == a[i - 1]
                    after = j < len(a) and k > 0 and dims.complement(b[k - 1]) == a[j]
                    if before or after:
                        continue
                    h = sum(dims.NEAREST[part[x : x + 2]][0] for x in range(len(part) - 1)) + sum((dims.INIT_GC if e in "GC" else dims.INIT_AT)[0] for e in (part[0], part[-1]))
                    t = sum(dims.NEAREST[part[x : x + 2]][1] for x in range(len(part) - 1)) + sum((dims.INIT_GC if e in "GC" else dims.INIT_AT)[1] for e in (part[0], part[-1]))
                    best = min(best, h - 310.15 * t / 1000)
        assert abs(align.dimer(a, b) - best) < 1e-5


def test_primer_pairs_brute(spark):
    rng = random.Random(13)
    rows = [(k, k % 3, dna(rng, 20)) for k in range(60)]
    df = spark.createDataFrame(rows, "primer_id int, seq_id int, sequence string")
    m = {r.primer_id: r for r in design.measured(df).collect()}
    for k, _, s in rows:
        run = max(len(list(g)) for _, g in __import__("itertools").groupby(s))
        gc = sum(c in "GC" for c in s) / 20
        assert m[k].run == run and abs(m[k].gc - gc) < 1e-12 and m[k].clamp == (s[-1] in "GC")
        assert m[k].ok == (55 <= m[k].tm <= 65 and 0.35 <= gc <= 0.65 and run <= 4)
    f, r = [x for x in rows if x[0] % 2], [x for x in rows if x[0] % 2 == 0]
    want = {(s1, a, b) for a, s1, _ in f for b, s2, _ in r if s1 == s2 and m[a].ok and m[b].ok and abs(m[a].tm - m[b].tm) <= 3}
    found = design.primer_pairs(df.where("primer_id % 2 = 1"), df.where("primer_id % 2 = 0"), "seq_id").collect()
    assert {(x.seq_id, x.forward_id, x.reverse_id) for x in found} == want and len(found) == len(want) > 0


def test_verdicts_brute(spark):
    """Reads of known constructs: exact, with changes, turned round, across an origin, and strangers."""
    rng = random.Random(14)
    mol = [(k, ("linear", "circular")[k % 2], dna(rng, 400)) for k in range(4)]
    reads, want = [], {}
    for k, t, s in mol:
        doubled = s + s if t == "circular" else s
        for j, at in enumerate((20, 150, 280 if t == "linear" else 350)):
            read = doubled[at : at + 90]
            changed = list(read)
            for x in range(20, 20 + 5 * j, 5):
                changed[x] = "ACGT"["ACGT".index(changed[x]) - 1]
            changed = "".join(changed)
            reads.append((10 * k + j, dims.revcomp(changed) if j == 1 else changed))
            want[10 * k + j] = (k, "reverse" if j == 1 else "forward", "match" if j == 0 else "differs")
    reads.append((99, dna(rng, 90)))
    found = {r.read_id: r for r in verify.verdicts(spark.createDataFrame(reads, "read_id int, bases string"), frame(spark, mol)).collect()}
    assert found[99].verdict == "not aligned"
    for i, (k, strand, verdict) in want.items():
        assert (found[i].seq_id, found[i].strand, found[i].verdict) == (k, strand, verdict)
        assert abs(found[i].identity - (90 - i % 10) / 90) < 1e-9


def test_columns_of_translations(spark):
    """Ambiguous codons in a joined coding sequence, other tables and open ends."""
    from strandwise.operators import cds

    rows = [(1, "GTGGCNTGATAG", [(0, 12)], "forward", 1, 2, False), (2, "GTGGCNTGATAG", [(0, 12)], "forward", 1, 1, True), (3, "CTATCANGCCAC", [(0, 12)], "reverse", 1, 4, False), (4, "AATGAAATTT", [(1, 4), (6, 10)], "forward", None, 99, None), (5, "TGAAATTTAA", [(8, 14)], "forward", 1, 1, False)]
    df = spark.createDataFrame([(k, s, len(s), seg, st, c, t, p, None) for k, s, seg, st, c, t, p in rows], "k int, sequence string, length int, segments array<struct<s:int,e:int>>, strand string, codon_start int, transl_table int, partial boolean, exceptions array<struct<codon:int,aa:string>>")
    found = {r.k: r.protein for r in cds.proteins(cds.codons(df, ["k"]), ["k"]).collect()}
    assert found == {1: "MAW*", 2: "VA**", 3: "MAW*", 4: "MI", 5: "NE"}
