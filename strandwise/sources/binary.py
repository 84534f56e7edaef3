"""Trace files (ABIF) and archives: binary sources read through Spark's binaryFile."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TRACE = "path string, name string, bases string, quality array<int>, peaks array<int>, a array<int>, c array<int>, g array<int>, t array<int>, error string"
MEMBER = "path string, member string, content binary, error string"
#: What an archive may unpack to: members, bytes of one and of all.
MEMBERS, MEMBER_BYTES, ARCHIVE_BYTES = 2000, 64 << 20, 512 << 20

_ENTRY = struct.Struct(">4sIHHIIII")


def parse_abif(data: bytes) -> dict:
    """Base calls, qualities, peak places and the four traces of a trace file."""
    if data[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    _, _, _, _, count, _, at, _ = _ENTRY.unpack_from(data, 6)
    entries = {}
    for k in range(count):
        tag, number, kind, size, n, total, place, _ = _ENTRY.unpack_from(data, at + k * _ENTRY.size)
        low = at + k * _ENTRY.size + 20 if total <= 4 else place
        if low + total > len(data):
            raise ValueError("a directory entry points outside the file")
        entries[tag.decode("latin-1"), number] = (kind, n, data[low : low + total])

    def text(*keys: tuple[str, int]) -> str:
        found = next((entries[k] for k in keys if k in entries), None)
        if found is None:
            return ""
        raw = found[2]
        return (raw[1 : 1 + raw[0]] if found[0] == 18 and raw else raw.rstrip(b"\0")).decode("latin-1")

    def numbers(*keys: tuple[str, int]) -> list[int]:
        found = next((entries[k] for k in keys if k in entries), None)
        if found is None:
            return []
        return list(found[2]) if found[0] in (1, 2) else list(struct.unpack(f">{found[1]}h", found[2][: 2 * found[1]]))

    bases = text(("PBAS", 2), ("PBAS", 1))
    if not bases:
        raise ValueError("no base calls")
    order = text(("FWO_", 1)) or "GATC"
    traces = {base.lower(): numbers(("DATA", 9 + k)) for k, base in enumerate(order)}
    return {"name": text(("SMPL", 1)), "bases": bases, "quality": numbers(("PCON", 2), ("PCON", 1)), "peaks": numbers(("PLOC", 2), ("PLOC", 1))} | {b: traces.get(b, []) for b in "acgt"}


def read_abif(spark: SparkSession, path: str) -> DataFrame:
    """A row for each trace file at path; a file that can't be read has its error."""
    names = [x.split()[0] for x in TRACE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for where, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append({"path": where} | parse_abif(bytes(data)))
                except (ValueError, struct.error) as problem:
                    rows.append({"path": where, "error": str(problem)})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TRACE)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file in the ZIP archives at path, within the limits above."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, data in zip(f["path"], f["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        infos = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/")]
                        if len(infos) > MEMBERS or sum(i.file_size for i in infos) > ARCHIVE_BYTES:
                            raise ValueError("the archive is larger than allowed")
                        for i in infos:
                            large = i.file_size > MEMBER_BYTES
                            rows.append((where, i.filename, None if large else z.read(i), "larger than allowed" if large else None))
                except (ValueError, zipfile.BadZipFile, RuntimeError) as problem:
                    rows.append((where, None, None, str(problem)))
                yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MEMBER)
