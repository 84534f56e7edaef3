"""GenBank, ABIF, archives, enzyme notation."""

import io
import struct
import zipfile

import pytest

from strandwise.sources import binary, detect, genbank, rebase

RECORD = '''LOCUS       TEST1                     24 bp    DNA     circular SYN 01-JAN-2020
DEFINITION  A small
            record.
ACCESSION   T00001
FEATURES             Location/Qualifiers
     gene            complement(join(<3..6,
                     10..12))
                     /gene="abc"
                     /note="two ""words"" on
                     two lines"
                     /pseudo
     CDS             join(20..24,1..>4)
                     /codon_start=1
     site            5^6
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
//
'''


@pytest.mark.parametrize("text", ["5", "3..9", "<3..>9", "5^6", "join(1..4,8..9)", "complement(3..9)", "complement(join(1..4,8..9))", "order(1..2,complement(4..6))"])
def test_locations_round_trip(text):
    operator, segments = genbank.parse_location(text)
    assert genbank.format_location(segments, operator) == text


@pytest.mark.parametrize("text", ["", "join(1..4", "a..b", "(3..4)"])
def test_bad_locations(text):
    with pytest.raises(ValueError):
        genbank.parse_location(text)


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gb").write_text(RECORD + RECORD.replace("TEST1", "TEST2").replace("24 bp", "25 bp") + "LOCUS\n//\n")
    one, two, bad = genbank.read_genbank(spark, str(tmp_path / "x.gb")).collect()
    assert (one.name, one.length, one.topology, one.definition, one.error) == ("TEST1", 24, "circular", "A small record.", None)
    gene, cds, site = one.features
    assert gene.strand == "reverse" and [(s.start, s.end) for s in gene.segments] == [(9, 12), (2, 6)] and gene.segments[1].partial_start
    assert [(q.name, q.value) for q in gene.qualifiers] == [("gene", "abc"), ("note", 'two "words" on two lines'), ("pseudo", None)]
    assert cds.operator == "join" and site.segments[0].start == site.segments[0].end == 5
    assert two.error.startswith("24 letters") and bad.error
    again = genbank.parse_record(genbank.write_record(one.asDict(recursive=True)))
    assert again["sequence"] == one.sequence and again["topology"] == "circular"
    assert [f["location"] for f in again["features"]] == ["complement(join(<3..6,10..12))", "join(20..24,1..>4)", "5^6"]


def abif(tags):
    body, entries = b"", b""
    base = 128
    for (tag, number), (kind, size, data) in tags.items():
        n = len(data) // size
        inline = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", base + len(body))
        entries += struct.pack(">4sIHHII", tag.encode(), number, kind, size, n, len(data)) + inline + bytes(4)
        body += b"" if len(data) <= 4 else data
    head = b"ABIF" + struct.pack(">H", 101) + struct.pack(">4sIHHIIII", b"tdir", 1, 1023, 28, len(tags), 28 * len(tags), base + len(body), 0)
    return head.ljust(base, b"\0") + body + entries


def test_abif(spark, tmp_path):
    tags = {("PBAS", 1): (2, 1, b"ACGTN"), ("PCON", 1): (2, 1, bytes([10, 20, 30, 40, 5])), ("PLOC", 1): (4, 2, struct.pack(">5h", 1, 2, 3, 4, 5)), ("FWO_", 1): (2, 1, b"GATC"), ("SMPL", 1): (18, 1, b"\x02s1"), ("DATA", 9): (4, 2, struct.pack(">3h", 7, 8, 9))}
    (tmp_path / "a.ab1").write_bytes(abif(tags))
    (tmp_path / "b.ab1").write_bytes(b"ABIFxx")
    rows = {r.path[-5:]: r for r in binary.read_abif(spark, f"{tmp_path}/*.ab1").collect()}
    a = rows["a.ab1"]
    assert (a.name, a.bases, a.quality, a.peaks, a.g, a.error) == ("s1", "ACGTN", [10, 20, 30, 40, 5], [1, 2, 3, 4, 5], [7, 8, 9], None)
    assert rows["b.ab1"].error and rows["b.ab1"].bases is None


def test_archive_and_detection(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("d/x.fa", ">a\nACGT\n")
        z.writestr("y.gb", RECORD)
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 nothing")
    rows = binary.read_archive(spark, f"{tmp_path}/*.zip")
    found = {r.member: r.f for r in rows.select("member", detect.detect_format(rows.content).alias("f")).collect()}
    assert found == {"d/x.fa": "fasta", "y.gb": "genbank", None: None}


@pytest.mark.parametrize("text,site,top,bottom", [("G^AATTC", "GAATTC", 1, 5), ("GGTCTC(1/5)", "GGTCTC", 7, 11), ("CTGGAG(16/14)", "CTGGAG", 22, 20), ("GAT^ATC", "GATATC", 3, 3)])
def test_notation(text, site, top, bottom):
    e = rebase.parse_site(text)
    assert (e["site"], e["cut_top"], e["cut_bottom"]) == (site, top, bottom)


def test_withrefm(spark, tmp_path):
    (tmp_path / "r.txt").write_text("REBASE\n\n<1>AaaI\n<2>XmaIII\n<3>C^GGCCG\n<7>N\n<8>ref\n\n<1>BcgI\n<2>\n<3>(10/12)CGANNNNNNTGC(12/10)\n<7>N\n\n<1>Bad\n<2>\n<3>?\n<7>\n")
    rows = {r.name: r for r in rebase.read_withrefm(spark, str(tmp_path / "r.txt")).collect()}
    assert rows["AaaI"].site == "CGGCCG" and rows["AaaI"].palindromic and rows["AaaI"].suppliers == "N"
    assert (rows["BcgI"].cut_top, rows["BcgI"].second_top) == (24, -10) and rows["Bad"].reason
    with pytest.raises(ValueError):
        rebase.parse_site("GAATTC")
