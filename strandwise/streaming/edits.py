"""Live edit logs: windowed counts with late data, and documents folded edit by edit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, ts timestamp, event_id bigint, op string, position int, len int, text string"
STATE = "version bigint, sequence string"


def edits_per_window(edits: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Edits and bases by document and event-time window; edits later than ``late`` are dropped
    once their window is closed."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = edits.withWatermark("ts", late).groupBy(w, "doc_id", "op").agg(F.count("*").alias("edits"), F.sum("len").alias("bases"))
    return g.select("doc_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "op", "edits", "bases")


def edit_sessions(edits: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of one document's edits with less than ``gap`` between them."""
    g = edits.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "doc_id").agg(F.count("*").alias("edits"))
    return g.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits")


def apply_edit(sequence: str, op: str, position: int, size: int, text: str) -> str:
    """insert: text at position; delete: size bases from it; replace: both. Places are clipped."""
    at = min(max(position, 0), len(sequence))
    end = at if op == "insert" else min(len(sequence), at + max(size, 0))
    return sequence[:at] + ("" if op == "delete" else text) + sequence[end:]


def fold_documents(edits: DataFrame, start: str = "") -> DataFrame:
    """doc_id, version, sequence after every batch: keyed state holds each document's text. Edits
    of a batch apply in the order of (ts, event_id); a null text is empty."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, sequence = state.get if state.exists else (0, start)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for e in rows.itertuples():
            sequence = apply_edit(sequence, e.op, int(e.position), int(e.len), e.text if isinstance(e.text, str) else "")
            version += 1
        state.update((version, sequence))
        yield pd.DataFrame({"doc_id": [key[0]], "version": [version], "sequence": [sequence]})

    return edits.groupBy("doc_id").applyInPandasWithState(fold, "doc_id bigint, version bigint, sequence string", STATE, "update", "NoTimeout")


def debounced(edits: DataFrame, quiet: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """doc_id, edits, ts, event_id: the last edit of each run that ``quiet`` ends, once the watermark has
    passed it (append mode): what an autosave would write."""
    last = F.max_by(F.struct("ts", "event_id"), F.struct("ts", "event_id"))
    g = edits.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "doc_id").agg(F.count("*").alias("edits"), last.alias("x"))
    return g.select("doc_id", "edits", F.col("x.ts").alias("ts"), F.col("x.event_id").alias("event_id"))


def expired_documents(edits: DataFrame, keep_ms: int, late: str = "10 minutes") -> DataFrame:
    """doc_id, edits, last_ms: documents untouched for keep_ms of event time, when the watermark says
    so; their state goes with them, and a later edit starts anew. The timer is set by each batch's last
    edit; edits older than the watermark count but never move the timer back."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "edits": [n], "last_ms": [last]})
            return
        n, last = state.get if state.exists else (0, 0)
        if n and state.getCurrentWatermarkMs() > last + keep_ms:  # it had expired before this batch came
            yield pd.DataFrame({"doc_id": [key[0]], "edits": [n], "last_ms": [last]})
            n, last = 0, 0
        for f in frames:
            n, last = n + len(f), max(last, int(f["ms"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))

    rows = edits.withWatermark("ts", late).select("doc_id", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("doc_id").applyInPandasWithState(fold, "doc_id bigint, edits bigint, last_ms bigint", "edits bigint, last_ms bigint", "append", "EventTimeTimeout")


def saved_edits(edits: DataFrame, saves: DataFrame, within: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Edits with the saves (save_id, doc_id, saved_at) of their document that follow within a time: a
    stream-stream join whose state the watermarks of both sides bound."""
    e = edits.withWatermark("ts", late).alias("e")
    s = saves.withWatermark("saved_at", late).alias("s")
    near = (F.col("e.doc_id") == F.col("s.doc_id")) & (F.col("s.saved_at") >= F.col("e.ts")) & (F.col("s.saved_at") <= F.col("e.ts") + F.expr(f"INTERVAL {within}"))
    return e.join(s, near).select("e.doc_id", "e.event_id", "s.save_id")


def write_batches(stream: DataFrame, path: str, checkpoint: str, **options):
    """Starts writing a stream to a folder for each batch. A batch that is run again after a failure
    overwrites its own folder, so every row is there once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
