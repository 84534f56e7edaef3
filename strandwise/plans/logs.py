"""Edit histories: undo steps, folds, undo and redo."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise import derive
from strandwise.operators import history
from strandwise.plans.registry import query

#: Bursts of typing: 13 events in a row go on at one caret; now and then a pause or a jump.
KEYS = "k AS (SELECT event_id // 130 AS doc_id, event_id * 700 + CASE WHEN event_id % 29 = 0 THEN 0 ELSE 2600 * (event_id // 29) END AS ms, event_id, CASE (event_id // 13) % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'backspace' WHEN 2 THEN 'delete' ELSE 'insert' END AS op, 1 + (event_id // 13) % 3 AS len, (event_id // 13) * 31 % 400 + 60 AS base, event_id % 13 AS turn, event_id % 17 = 3 AS jump FROM events), typed AS (SELECT doc_id, ms, event_id, op, (CASE op WHEN 'insert' THEN base + turn * len WHEN 'backspace' THEN base - turn * len ELSE base END + CASE WHEN jump THEN 7 ELSE 0 END)::INT AS position, len::INT AS len FROM k)"


def _typed(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events").select("event_id")
    k, burst = F.col("event_id"), F.floor(F.col("event_id") / 13)
    op = F.when(burst % 4 == 1, "backspace").when(burst % 4 == 2, "delete").otherwise("insert")
    rows = e.select("event_id", F.floor(k / 130).alias("doc_id"), (k * 700 + F.when(k % 29 == 0, 0).otherwise(2600 * F.floor(k / 29))).alias("ms"), op.alias("op"), (1 + burst % 3).cast("int").alias("len"), (burst * 31 % 400 + 60).alias("base"), (k % 13).alias("turn"), (k % 17 == 3).alias("jump"))
    at = F.when(F.col("op") == "insert", F.col("base") + F.col("turn") * F.col("len")).when(F.col("op") == "backspace", F.col("base") - F.col("turn") * F.col("len")).otherwise(F.col("base"))
    return rows.select("doc_id", "ms", "event_id", "op", (at + F.when(F.col("jump"), 7).otherwise(0)).cast("int").alias("position"), "len")


STEPS = KEYS + ", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ms, event_id) AS r FROM typed), s AS (SELECT doc_id, r, event_id, op, ms, len, CASE op WHEN 'insert' THEN position + len ELSE position END AS caret, 1 AS step, 1 AS held FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.r, o.event_id, o.op, o.ms, o.len, CASE o.op WHEN 'insert' THEN o.position + o.len ELSE o.position END, CASE WHEN j.joins THEN s.step ELSE s.step + 1 END, CASE WHEN j.joins THEN s.held + 1 ELSE 1 END FROM s JOIN o ON o.doc_id = s.doc_id AND o.r = s.r + 1, LATERAL (SELECT o.op = s.op AND o.ms - s.ms <= 2000 AND s.held < 60 AND s.caret = CASE o.op WHEN 'backspace' THEN o.position + o.len ELSE o.position END AS joins) j)"


@query("WITH RECURSIVE " + STEPS + " SELECT doc_id::BIGINT AS doc_id, step::BIGINT AS step, min(op) AS op, count(*) AS edits, sum(len)::BIGINT AS bases FROM s GROUP BY 1, 2")
def undo_steps(spark, sf_dir):
    """Typing and deleting runs that one undo takes back: same kind, at the caret, within two seconds,
    sixty edits at most."""
    t = _typed(spark, sf_dir)
    s = history.undo_steps(t).join(t.select("doc_id", "event_id", "op", "len"), ["doc_id", "event_id"])
    return s.groupBy("doc_id", "step").agg(F.min("op").alias("op"), F.count("*").alias("edits"), F.sum("len").alias("bases"))


LETTERS = "translate(substr(md5(event_id::VARCHAR), 1, len), '0123456789abcdef', 'ACGTACGTACGTACGT')"
FOLD = f"e AS (SELECT user_id AS doc_id, event_id, CASE event_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'replace' END AS op, event_id * 7 % 500 AS at_, event_id % 9 + 1 AS len, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT DISTINCT doc_id, 0::BIGINT AS r, repeat('ACGT', 100) AS text FROM e UNION ALL SELECT e.doc_id, e.r, substr(f.text, 1, least(at_, length(f.text))) || CASE WHEN op = 'delete' THEN '' ELSE {LETTERS} END || substr(f.text, CASE WHEN op = 'insert' THEN least(at_, length(f.text)) ELSE least(at_ + len, length(f.text)) END + 1) FROM f JOIN e ON e.doc_id = f.doc_id AND e.r = f.r + 1)"


@query("WITH RECURSIVE " + FOLD.replace("at_", '"at"') + " SELECT doc_id, max(r)::BIGINT AS versions, length(arg_max(text, r))::BIGINT AS length, sha1(arg_max(text, r)) AS digest FROM f GROUP BY 1")
def document_fold(spark, sf_dir):
    """Every document's text after all of its edits, clipped to the text as it then was."""
    e = derive.table(spark, sf_dir, "events")
    k = F.col("event_id")
    op = F.when(k % 3 == 0, "delete").when(k % 3 == 1, "insert").otherwise("replace")
    size = (k % 9 + 1).cast("int")
    new = F.translate(F.substring(F.md5(k.cast("string")), F.lit(1), size), "0123456789abcdef", derive.PLAIN)
    rows = e.select(F.col("user_id").alias("doc_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), "event_id", op.alias("op"), (k * 7 % 500).cast("int").alias("position"), size.alias("len"), new.alias("text"))
    return history.fold_text(rows, "ACGT" * 100).select("doc_id", "versions", F.length("text").cast("bigint").alias("length"), F.sha1("text").alias("digest"))


UNDO = "e AS (SELECT user_id AS doc_id, CASE WHEN event_id % 5 IN (1, 3) THEN 'undo' WHEN event_id % 7 = 2 THEN 'redo' ELSE 'edit' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), u AS (SELECT DISTINCT doc_id, 0::BIGINT AS r, 0::BIGINT AS p, 0::BIGINT AS n FROM e UNION ALL SELECT e.doc_id, e.r, CASE op WHEN 'undo' THEN greatest(p - 1, 0) WHEN 'redo' THEN least(n, p + 1) ELSE p + 1 END, CASE WHEN op = 'edit' THEN p + 1 ELSE n END FROM u JOIN e ON e.doc_id = u.doc_id AND e.r = u.r + 1)"


@query("WITH RECURSIVE " + UNDO + " SELECT doc_id, arg_max(p, r)::BIGINT AS position, arg_max(n, r)::BIGINT AS size FROM u GROUP BY 1")
def undo_redo(spark, sf_dir):
    """Applied and kept steps after a log of edits, undos and redos."""
    k = F.col("event_id")
    op = F.when((k % 5).isin(1, 3), "undo").when(k % 7 == 2, "redo").otherwise("edit")
    rows = derive.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), "event_id", op.alias("op"))
    return history.undo_redo(rows)
