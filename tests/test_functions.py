"""Sequence functions and dynamic programming against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.functions import seq as S
from strandwise.operators import align, digest, scan
from strandwise.streaming.edits import apply_edit


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head().x


@pytest.mark.parametrize("codon,aa", [("ATG", "M"), ("TAA", "*"), ("GCN", "A"), ("NNN", "X"), ("atg", "M"), ("UGG", "W"), ("A?G", "X"), ("AT", "X"), ("TAR", "*")])
def test_codons(spark, codon, aa):
    assert one(spark, S.translate_codon(F.col("c")), c=codon) == aa


def test_translate_mixed(spark):
    assert one(spark, S.translate(F.col("c")), c="ATGGCNTAAGG") == "MA*"
    assert one(spark, S.translate(F.col("c"), 1, 1), c="CATGTAA") == "M*"
    assert one(spark, S.translate(F.col("c")), c="") == ""


def test_every_code_has_64_letters():
    assert all(len(a) == len(s) == 64 for _, _, a, s in dims.GENETIC_CODES)
    assert all(len(dims.revcomp(s)) == len(s) for _, s, _, _ in dims.ENZYMES)


def test_gc_weights(spark):
    gc, counted = S.gc_sixths(F.col("c"))
    assert one(spark, gc, c="GCSATWRYKMBVDHN") == 18 + 12 + 8 + 4
    assert one(spark, counted, c="GCSATWRYKMBVDHN") == 14 * 6
    assert one(spark, S.gc_content(F.col("c")), c="NNN") is None


def test_melting_edges(spark):
    assert one(spark, S.melting(F.col("c")), c="A") is None
    assert one(spark, S.melting(F.col("c")), c="ACGN") is None
    assert one(spark, S.melting(F.col("c")), c="acgu") == one(spark, S.melting(F.col("c")), c="ACGT")


def brute_trim(q, cutoff=0.05):
    best, span = 0.0, (0, 0)
    for i in range(len(q)):
        for j in range(i + 1, len(q) + 1):
            total = sum(cutoff - 10 ** (-x / 10) for x in q[i:j])
            if total > best + 1e-12:
                best, span = total, (i, j)
    return best, span


def test_mott(spark):
    rng = random.Random(4)
    for _ in range(12):
        q = [rng.choice([2, 8, 12, 14, 20, 35]) for _ in range(14)]
        t = one(spark, S.mott_trim(F.col("q")), q=q)
        score = sum(0.05 - 10 ** (-x / 10) for x in q[t.start : t.end])
        assert abs(score - brute_trim(q)[0]) < 1e-9
    assert tuple(one(spark, S.mott_trim(F.col("q")), q=[2, 2])) == (0, 0)


def brute_score(a, b, local):
    """Best score over all alignments, by recursion over (i, j, layer)."""
    from functools import cache

    @cache
    def go(i, j, layer):
        out = [0.0] if local or (i == len(a) and j == len(b)) else []
        if i < len(a) and j < len(b):
            out.append((align.MATCH if a[i] == b[j] else align.MISMATCH) + go(i + 1, j + 1, 0))
        if i < len(a):
            out.append((align.EXTEND if layer == 1 else align.OPEN) + go(i + 1, j, 1))
        if j < len(b):
            out.append((align.EXTEND if layer == 2 else align.OPEN) + go(i, j + 1, 2))
        return max(out)

    return max(go(i, j, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)) if local else go(0, 0, 0)


@pytest.mark.parametrize("local", [False, True])
def test_alignment_scores(local):
    rng = random.Random(7)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        r = align.align(a, b, local)
        assert abs(r["score"] - brute_score(a, b, local)) < 1e-6, (a, b)
        assert r["gapped_a"].replace("-", "") == a[r["start_a"] : r["end_a"]]
        assert r["gapped_b"].replace("-", "") == b[r["start_b"] : r["end_b"]]


def brute_cuts(seq, circular, site, top):
    n, out = len(seq), []
    text = seq + seq[: len(site) - 1] if circular else seq
    for i in range(n if circular else n - len(site) + 1):
        if len(site) <= n and all(set(dims.IUPAC[c]) <= set(dims.IUPAC[s]) for c, s in zip(text[i : i + len(site)], site, strict=False)):
            out.append((i + top) % n if circular else i + top)
    return sorted(out)


def test_cut_sites_over_the_origin(spark):
    rng = random.Random(2)
    mol = [(k, t, s, len(s)) for k, (t, s) in enumerate(itertools.product(["linear", "circular"], ["", "GA", "ATTCG", "GAATTC", "AATTCG", *["".join(rng.choice("ACGTN") for _ in range(40)) for _ in range(6)]]))]
    df = spark.createDataFrame(mol, "seq_id int, topology string, sequence string, length int")
    found = scan.cut_sites(df, dims.enzymes(spark, [("EcoRI", "GAATTC", 1, 5), ("HinfI", "GANTC", 1, 4)])).collect()
    for k, t, s, _ in mol:
        for name, site, top in (("EcoRI", "GAATTC", 1), ("HinfI", "GANTC", 1)):
            assert sorted(r.cut for r in found if (r.seq_id, r.enzyme) == (k, name)) == brute_cuts(s, t == "circular", site, top), (t, s, name)


def test_fragments(spark):
    mol = spark.createDataFrame([(1, "linear", 10), (2, "circular", 10), (3, "circular", 10), (4, "linear", 10), (5, "circular", 10)], "seq_id int, topology string, length int")
    cuts = spark.createDataFrame([(1, 0), (1, 4), (1, 10), (2, 3), (3, 2), (3, 7), (3, 7)], "seq_id int, cut int")
    found = {(r.seq_id, r.start, r.end) for r in digest.fragments(mol, cuts, ["seq_id"]).collect()}
    assert found == {(1, 0, 4), (1, 4, 10), (2, 3, 13), (3, 2, 7), (3, 7, 12), (4, 0, 10), (5, 0, 10)}


def test_edits():
    assert apply_edit("ACGT", "insert", 2, 3, "xx") == "ACxxGT"
    assert apply_edit("ACGT", "delete", 1, 2, "") == "AT"
    assert apply_edit("ACGT", "replace", 3, 9, "g") == "ACGg"
