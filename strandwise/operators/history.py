"""Edit logs in order: undo steps, and documents folded from their edits.

Both need a log's rows one after another, so logs are dealt by document and sorted, and a mapper
walks over them in Arrow batches with the state of the one document at hand: no log is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAUSE_MS, MOST = 2000, 60


def _sorted(edits: DataFrame) -> DataFrame:
    return edits.repartition("doc_id").sortWithinPartitions("doc_id", "ms", "event_id")


def undo_steps(edits: DataFrame, pause_ms: int = PAUSE_MS, most: int = MOST) -> DataFrame:
    """doc_id, event_id, step: the undo step, counted from 1, that each edit (doc_id, ms, event_id,
    op, position, len) is part of.

    An edit joins the step before it when it is of the same kind, goes on at the caret that one left
    (an insert where it ended, a backspace before it, a forward delete at the same place), follows
    within ``pause_ms`` and the step holds fewer than ``most``. Replacements are steps of their own.
    op: insert, backspace, delete, replace; a null op is a step of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, step, held, last_op, caret, last_ms = object(), 0, 0, None, -1, 0
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for k, (d, ms, _, op, at, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                at, n = at or 0, n or 0
                before = at + n if op == "backspace" else at
                joins = d == doc and op == last_op and op in ("insert", "backspace", "delete") and before == caret and ms - last_ms <= pause_ms and held < most
                if d != doc:
                    step = 0
                if joins:
                    held += 1
                else:
                    step, held = step + 1, 1
                doc, last_op, last_ms, caret = d, op, ms, at + n if op == "insert" else at
                out[k] = step
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], names=["doc_id", "event_id", "step"])

    rows = _sorted(edits.select("doc_id", "ms", "event_id", "op", "position", "len"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, event_id {kinds['event_id']}, step bigint")


def fold_text(edits: DataFrame, start: str = "") -> DataFrame:
    """doc_id, versions, text: each document after all edits (doc_id, ms, event_id, op, position, len,
    text) applied to ``start``. Places are clipped to the text as edited so far: an insert puts text
    in, a delete takes len letters from position on, a replace does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, text, versions, seen = None, start, 0, False
        done: list[tuple] = []
        for batch in batches:
            for d, _, _, op, at, n, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen and d != doc:
                    done.append((doc, versions, text))
                    text, versions = start, 0
                doc, seen, versions = d, True, versions + 1
                low = min(max(at or 0, 0), len(text))
                high = low if op == "insert" else min(len(text), max((at or 0) + (n or 0), low))
                text = text[:low] + ("" if op == "delete" else new or "") + text[high:]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((batch.column(0).type, pa.int64(), pa.string()))], names=["doc_id", "versions", "text"])
            kind, done = batch.column(0).type, []
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([doc], kind), pa.array([versions], pa.int64()), pa.array([text])], names=["doc_id", "versions", "text"])

    rows = _sorted(edits.select("doc_id", "ms", "event_id", "op", "position", "len", "text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, versions bigint, text string")


def undo_redo(log: DataFrame) -> DataFrame:
    """doc_id, position, size: how many steps are applied and how many are kept after a log (doc_id,
    ms, event_id, op) of edits, undos and redos. An edit after undos discards what could be redone; an
    undo of nothing and a redo of nothing are no-ops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seen, at, size, kind = None, False, 0, 0, None
        for batch in batches:
            kind, out = batch.column(0).type, []
            for d, op in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if seen and d != doc:
                    out.append((doc, at, size))
                    at = size = 0
                doc, seen = d, True
                if op == "undo":
                    at = max(0, at - 1)
                elif op == "redo":
                    at = min(size, at + 1)
                else:
                    at = size = at + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind, pa.int64(), pa.int64()))], names=["doc_id", "position", "size"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([doc], kind), pa.array([at]), pa.array([size])], names=["doc_id", "position", "size"])

    rows = _sorted(log.select("doc_id", "ms", "event_id", "op"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, position bigint, size bigint")
