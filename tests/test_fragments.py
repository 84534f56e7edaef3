"""Digests of long molecules, ligation by tube and products within reach."""

import random

from strandwise.operators import anneal, ends


def test_long_circle_moves_its_text_once(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(1000)) * 5000  # 5 Mb
    mol = spark.createDataFrame([(1, "circular", len(text), text), (2, "linear", len(text), text)], "seq_id int, topology string, length int, sequence string")
    at = [k for k in range(0, len(text), 250)]
    cuts = spark.createDataFrame([(s, k, k + 4) for s in (1, 2) for k in at], "seq_id int, cut int, cut_bottom int")
    got = ends.cut_fragments(mol, cuts)
    per = {r.seq_id: (r.n, r.bases) for r in got.selectExpr("seq_id", "length(sequence) AS size").groupBy("seq_id").agg({"size": "sum", "*": "count"}).toDF("seq_id", "bases", "n").collect()}
    assert per == {1: (20_000, len(text)), 2: (20_000, len(text))}
    one = got.where("seq_id = 1 AND start = 4999750").head()
    assert one.end == 5_000_000 and one.right_overhang == text[:4] and one.left_overhang == text[4_999_750 : 4_999_754] and one.sequence == text[-250:]


def test_junctions_by_tube(spark):
    rows = [("a", 1, 0, "end", "", "five_prime", "AATT"), ("a", 2, 0, "five_prime", "AATT", "blunt", ""), ("b", 3, 0, "five_prime", "AATT", "blunt", ""), ("a", 4, 0, "blunt", "", "end", ""), (None, 5, 0, "blunt", "", "blunt", "")]
    f = spark.createDataFrame(rows, "tube string, seq_id int, start int, left_kind string, left_overhang string, right_kind string, right_overhang string")
    assert sorted(map(tuple, ends.junctions(f).collect())) == [("a", 1, 0, 2, 0), ("a", 2, 0, 4, 0)]


def test_products_within_reach_are_those_of_all(spark):
    rng = random.Random(5)
    rows = []
    for mol in range(6):
        n = rng.randrange(300, 900)
        for k in range(30):
            rows.append((mol, "circular" if mol % 2 else "linear", n, k, rng.choice(["forward", "reverse"]), rng.randrange(n - 20), 20, rng.randrange(3)))
    sites = spark.createDataFrame(rows, "seq_id int, topology string, length int, primer_id int, strand string, start int, size int, mismatches int")
    for reach in (60, 200, 5000):
        want = sorted(map(tuple, anneal.amplicons(sites).where(f"size <= {reach}").collect()))
        assert sorted(map(tuple, anneal.amplicons(sites, reach=reach).collect())) == want and want
