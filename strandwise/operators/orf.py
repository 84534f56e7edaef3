"""Open reading frames.

Codons are read on both strands of all molecules of an Arrow batch at once. A stop's frame is the
set of codons back to the stop before it; the first start among them is found by one binary search
over (molecule, frame, position), so a molecule costs n log n, circles as well as lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwise import dims
from strandwise.operators.scan import MASKS, PIECE, TURNED, codes

FAR = 1 << 36
ORF = "strand string, frame int, start int, end int"
_TURNED = bytes(TURNED)


def _orfs(texts: list[bytes], circle: bool, starts: list[int], stops: list[int], min_codons: int) -> list[np.ndarray]:
    """Text, frame, start and end of the frames of texts read forward."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    buf = b"\0".join(t + t[:2] if circle else t for t in texts) + b"\0\0\0"
    low = np.cumsum([0, *(size + (3 if circle else 1))])[:-1]
    number, plain = codes(MASKS[np.frombuffer(buf, np.uint8)], 3)

    def marks(words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(plain & np.isin(number, words))
        text = np.searchsorted(low, at, side="right") - 1
        pos = at - low[text]
        good = pos < size[text] if circle else pos + 3 <= size[text]
        return text[good], pos[good]

    def keyed(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """On a circle every mark stands twice: as it is read in the turn before, and in this one."""
        if circle:
            text, pos = np.concatenate([text, text]), np.concatenate([pos, pos + size[text]])
        return np.sort((text * 3 + pos % 3) * FAR + pos)

    stop_text, stop_pos = marks(stops)
    start_keys, stop_keys = keyed(*marks(starts)), keyed(stop_text, stop_pos)
    pos = stop_pos + size[stop_text] if circle else stop_pos
    frame = (stop_text * 3 + pos % 3) * FAR
    before = np.searchsorted(stop_keys, frame + pos) - 1
    wall = np.where((before >= 0) & (stop_keys[before] >= frame), stop_keys[before] - frame, -1) if len(stop_keys) else pos
    if circle:  # no stretch is longer than the circle
        wall = np.maximum(wall, pos - size[stop_text] + 2)
    first = np.searchsorted(start_keys, frame + wall, side="right")
    there = first < len(start_keys)
    begin = np.where(there, start_keys[np.minimum(first, max(len(start_keys) - 1, 0))] - frame, FAR) if len(start_keys) else np.full(len(pos), FAR)
    good = (begin < pos) & ((pos - begin) // 3 >= min_codons)
    text, begin, end = stop_text[good], begin[good], pos[good] + 3
    if circle:
        turn = begin // size[text] * size[text]
        begin, end = begin - turn, end - turn
    return [text, begin % 3, begin, end]


def orfs(mol: DataFrame, min_codons: int = 75, starts: tuple[str, ...] = ("ATG",), table: int = 1) -> DataFrame:
    """seq_id, strand, frame, start, end in strand coordinates. On a line, from the first start after
    a stop to the next stop in frame; stretches open at an end are none. On a circle, one for each
    stop: the farthest start back to the previous stop in frame whose stretch isn't longer than the
    circle; start lies in 0 .. length - 1, end may pass the length."""
    rank = lambda c: sum("ACGT".index(b) << 2 * (2 - k) for k, b in enumerate(c))
    first, last = [rank(c) for c in starts], [rank(c) for c, a in dims.code_table(table).items() if a == "*"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(1).cast(pa.binary()).to_pylist()
            circles = [t == "circular" for t in batch.column(2).to_pylist()]
            for circle in (False, True):
                rows = [k for k, c in enumerate(circles) if c == circle and len(seqs[k] or b"") >= (6 if circle else 3)]
                while rows:
                    total = np.cumsum([len(seqs[k]) for k in rows])
                    n = max(1, int(np.searchsorted(total, PIECE)))
                    held, rows = rows[:n], rows[n:]
                    for strand, texts in (("forward", [seqs[k] for k in held]), ("reverse", [seqs[k].translate(_TURNED)[::-1] for k in held])):
                        text, *cols = _orfs(texts, circle, first, last, min_codons)
                        own = batch.column(0).take(pa.array(np.array(held, dtype=np.int64)[text]))
                        yield pa.RecordBatch.from_arrays([own, pa.array([strand] * len(text), pa.string()), *(pa.array(c.astype(np.int32)) for c in cols)], names=["seq_id", "strand", "frame", "start", "end"])

    kind = dict(mol.dtypes)["seq_id"]
    return mol.select("seq_id", "sequence", "topology").mapInArrow(run, f"seq_id {kind}, {ORF}")


def linear_orfs(mol: DataFrame, min_codons: int = 75, **options) -> DataFrame:
    return orfs(mol.where("topology = 'linear'"), min_codons, **options)


def circular_orfs(mol: DataFrame, min_codons: int = 75, **options) -> DataFrame:
    return orfs(mol.where("topology = 'circular'"), min_codons, **options)
