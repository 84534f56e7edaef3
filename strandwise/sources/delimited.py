"""Tables of oligos and batches: delimited text and spreadsheets in, delimited text and aligned formats out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import seq as S

NAMES, BASES = ("name", "primer", "oligo", "id", "primer name", "oligo name"), ("sequence", "seq", "bases", "primer sequence")
_CELL = re.compile(r"([A-Z]+)(\d+)")


def read_oligos(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """row, name, sequence, error: a delimited table with a heading line. Which columns hold names and
    bases is told by their headings; white space and digits in bases are dropped. A file is split between
    tasks only where no quoted cell holds a line end; such cells are read too."""
    t = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    held = {c.strip().lower(): c for c in t.columns}
    pick = lambda wanted: next((held[w] for w in wanted if w in held), None)
    name, bases = pick(NAMES), pick(BASES)
    if bases is None:
        raise ValueError(f"no column of bases among {t.columns}")
    text = S.normalise(F.coalesce(F.col(f"`{bases}`"), F.lit("")))
    own = F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name else F.lit("")
    error = F.when(text == "", "no bases").when(~S.is_nucleotide(text), "letters").when(own == "", "no name")
    return t.select(own.alias("name"), text.alias("sequence"), error.alias("error"))


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A delimited table with a heading; cells that a spreadsheet would take for a formula are quoted by an apostrophe."""
    safe = [F.when(F.col(c).rlike(r"^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes]
    df.select(*safe).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of a workbook: shared and inline text, numbers as written."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for row in ElementTree.fromstring(z.read(name)).iter(f"{space}row"):
                cells: list[str | None] = []
                number = int(row.get("r") or 0)
                for c in row.iter(f"{space}c"):
                    at = _CELL.fullmatch(c.get("r") or "")
                    place = _column(at[1]) if at else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value = c.find(f"{space}v")
                    if c.get("t") == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in c.iter(f"{space}t"))
                    elif value is not None:
                        cells[place] = shared[int(value.text or 0)] if c.get("t") == "s" else value.text
                out.append((name.rsplit("/", 1)[1][:-4], number, cells))
    return out


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells, error: the rows of all workbooks under a path, a workbook to a task; a
    damaged one gives a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, *r, None) for r in sheet_rows(bytes(data))]
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as problem:
                    rows.append((p, None, None, None, f"{type(problem).__name__}: {problem}"))
            out = pd.DataFrame(rows, columns=["path", "sheet", "row", "cells", "error"])
            out["row"] = out["row"].astype("Int32")
            yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>, error string")


def clustal(rows: pd.DataFrame, width: int = 60) -> str:
    """Aligned rows (name, aligned) as blocks of ``width`` columns with a line of marks under each."""
    names = [re.sub(r"\s+", "_", n) for n in rows["name"]]
    pad = max(map(len, names), default=0) + 3
    size = max(map(len, rows["aligned"]), default=0)
    marks = "".join("*" if len({r[k : k + 1] for r in rows["aligned"]}) == 1 and rows["aligned"].iloc[0][k : k + 1] not in ("-", "") else " " for k in range(size))
    out = ["CLUSTAL W multiple sequence alignment", ""]
    for low in range(0, size, width):
        out += [n.ljust(pad) + r[low : low + width] for n, r in zip(names, rows["aligned"], strict=True)]
        out += [(" " * pad + marks[low : low + width]).rstrip(), ""]
    return "\n".join(out)


def clustal_texts(rows: DataFrame, key: str) -> DataFrame:
    """key, text: each aligned set (key, name, aligned) in Clustal format, rows by name."""
    kind = dict(rows.dtypes)[key]
    return rows.select(key, "name", "aligned").groupBy(key).applyInPandas(lambda f: pd.DataFrame({key: f[key].iloc[:1], "text": [clustal(f.sort_values("name"))]}), f"`{key}` {kind}, text string")
