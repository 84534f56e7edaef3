"""What format a file's first bytes tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detect_format(content: Column) -> Column:
    """abif, zip, snapgene, genbank, fasta, fastq, raw (letters only) or null."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    text = F.regexp_replace(head, r"^[\s\x{EF}\x{BB}\x{BF}]+", "")
    return (
        F.when(head.startswith("ABIF"), "abif")
        .when(head.startswith("PK\x03\x04"), "zip")
        .when(head.rlike(r"(?s)^\t.{4}SnapGene"), "snapgene")
        .when(text.startswith("LOCUS "), "genbank")
        .when(text.startswith(">") | text.startswith(";"), "fasta")
        .when(text.startswith("@"), "fastq")
        .when(text.rlike(r"^[A-Za-z\s0-9*-]+$"), "raw")
    )
