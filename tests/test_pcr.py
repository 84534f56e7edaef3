"""Products as molecules."""

from strandwise import dims
from strandwise.operators import pcr


def test_texts():
    t = "AACCGGTTACGTACGTTTGGCCAA"
    assert pcr.product_text(t, False, 2, 20, t[2:7], dims.revcomp(t[17:22])) == t[2:22]
    assert pcr.product_text(t, False, 2, 20, "TTTTT", dims.revcomp(t[17:22]), ("GG", "AC")) == "GGTTTTT" + t[7:22] + "GT"
    assert pcr.product_text(t, True, 20, 10, t[20:24], dims.revcomp(t[2:6])) == t[20:] + t[:6]
    assert pcr.product_text(t, False, 20, 10, t[20:24], "ACGT") is None and pcr.product_text(t, True, 3, 25, "ACG", "ACG") is None
    assert pcr.product_text(t, False, 2, 7, t[2:7], dims.revcomp(t[4:9])) == t[2:9]  # overlapping primers


def test_rows(spark):
    mol = spark.createDataFrame([(1, "linear", "AACCGGTTACGTACGTTTGGCCAA"), (2, "linear", None), (None, "linear", "ACGT")], "seq_id int, topology string, sequence string")
    primers = spark.createDataFrame([(1, "CCGGT", "GG"), (2, dims.revcomp("TTTGG"), None), (3, None, "A")], "primer_id int, sequence string, tail string")
    products = spark.createDataFrame([(1, 1, 2, 2, 18), (1, 1, 3, 2, 18), (2, 1, 2, 2, 18), (9, 1, 2, 2, 18), (1, 1, 2, None, 18), (None, 1, 2, 0, 4)], "seq_id int, forward_id int, reverse_id int, start int, size int")
    assert [tuple(r) for r in pcr.product_texts(products, mol, primers).collect()] == [(1, 1, 2, 2, 18, "GG" + "AACCGGTTACGTACGTTTGGCCAA"[2:20])]
