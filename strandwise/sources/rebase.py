"""Enzyme catalogues in REBASE's withrefm form, and single enzymes in its notation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise import dims

ENZYME = "name string, site string, cut_top int, cut_bottom int, palindromic boolean, second_top int, second_bottom int, suppliers string, reason string"


def parse_site(text: str) -> dict:
    """site, cut_top, cut_bottom (and second_*) of a notation: ``G^AATTC`` or ``GGTCTC(1/5)``, with
    cuts on both sides as ``(8/13)GGATC(4/5)``. ValueError where no cut is told or letters are odd."""
    m = re.fullmatch(r"(?:\((-?\d+)/(-?\d+)\))?([A-Za-z^]+)(?:\((-?\d+)/(-?\d+)\))?", text.strip())
    if not m:
        raise ValueError("not a recognition site")
    letters, marks = m[3].replace("^", "").upper(), m[3].count("^")
    if set(letters) - set(dims.IUPAC) or not letters:
        raise ValueError("letters that are no bases")
    n, cuts = len(letters), []
    if m[4] is not None:
        cuts.append((n + int(m[4]), n + int(m[5])))
    if m[1] is not None:
        cuts.append((-int(m[1]), -int(m[2])))
    if marks == 1 and not cuts:
        at = m[3].index("^")
        cuts.append((at, n - at))
    if not cuts or marks > 1 or (marks and m[4] is not None):
        raise ValueError("no cut is told" if not cuts else "two notations at once")
    out = {"site": letters, "cut_top": cuts[0][0], "cut_bottom": cuts[0][1], "palindromic": dims.revcomp(letters) == letters, "second_top": None, "second_bottom": None}
    if len(cuts) > 1:
        out |= {"second_top": cuts[1][0], "second_bottom": cuts[1][1]}
    return out


def read_withrefm(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record (<1>name <3>site <7>suppliers ...); those without a usable site have
    their reason."""
    raw = spark.read.text(path, lineSep="\n<1>").where(F.col("value").contains("<3>"))
    field = lambda n: F.regexp_extract("value", rf"(?s)<{n}>([^\n\r]*)", 1)
    rows = raw.select(F.trim(F.regexp_extract("value", r"(?:<1>)?([^\n\r<]+)[\n\r]", 1)).alias("name"), field(3).alias("text"), field(7).alias("suppliers"))

    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in ENZYME.split(", ")]
        for f in frames:
            out = []
            for name, text, suppliers in zip(f["name"], f["text"], f["suppliers"], strict=True):
                try:
                    found = parse_site(text.split(",")[0]) | {"reason": None}
                except ValueError as problem:
                    found = {"reason": str(problem)}
                out.append({"name": name, "suppliers": suppliers} | found)
            d = pd.DataFrame(out, columns=names)
            for c in ("cut_top", "cut_bottom", "second_top", "second_bottom"):
                d[c] = d[c].astype("Int32")
            yield d.astype({"palindromic": object})

    return rows.mapInPandas(run, ENZYME)
