"""Documents, histories, lineages, batches, assemblies: the record-keeping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise import derive
from strandwise.derive import with_views as views
from strandwise.functions import seq as S
from strandwise.operators import cloning, history, relations
from strandwise.plans.registry import query
from strandwise.sources import text



@query(views("edits", more="g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 OR op <> lag(op) OVER w THEN 1 ELSE 0 END AS new FROM edits WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS step FROM g)") + "SELECT doc_id, step::BIGINT AS step, min(op) AS op, count(*) AS edits, sum(len)::BIGINT AS bases FROM s GROUP BY 1, 2")
def history_sessions(spark, sf_dir):
    """Working days: runs of the same kind of edit with less than a day between them."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))
    new = F.when(gap.isNull() | (gap > 86_400_000_000) | (F.col("op") != F.lag("op").over(w)), 1).otherwise(0)
    s = derive.edits(spark, sf_dir).withColumn("new", new).withColumn("step", F.sum("new").over(w))
    return s.groupBy("doc_id", "step").agg(F.min("op").alias("op"), F.count("*").alias("edits"), F.sum("len").alias("bases"))


@query("WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS r FROM (" + derive.SQL["edits"] + ")), f AS (SELECT DISTINCT doc_id, 0::BIGINT AS r, 100::BIGINT AS n FROM e UNION ALL SELECT e.doc_id, e.r, CASE op WHEN 'insert' THEN n + len ELSE n - (least(position + len, n) - least(position, n)) + CASE op WHEN 'replace' THEN len ELSE 0 END END FROM f JOIN e ON e.doc_id = f.doc_id AND e.r = f.r + 1) SELECT doc_id, max(r)::BIGINT AS versions, arg_max(n, r)::BIGINT AS length FROM f GROUP BY 1")
def edit_log_fold(spark, sf_dir):
    """Length of every document after its edits, clipped to the text as it then was."""
    e = derive.edits(spark, sf_dir)
    rows = e.select("doc_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "op", "position", "len", F.repeat(F.lit("N"), F.col("len")).alias("text"))
    return history.fold_text(rows, "N" * 100).select("doc_id", "versions", F.length("text").cast("bigint").alias("length"))


@query(views("edits", more="l AS (SELECT doc_id, max(ts) AS last FROM edits GROUP BY 1)") + "SELECT doc_id, last < (SELECT max(ts) FROM edits) - INTERVAL 30 DAY AS expired FROM l")
def scratch_ttl(spark, sf_dir):
    """Documents untouched for 30 days before the newest edit."""
    e = derive.edits(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("doc_id").agg(F.max("ts").alias("last"))
    return last.join(F.broadcast(now)).select("doc_id", (F.col("last") < F.col("now") - F.expr("INTERVAL 30 DAYS")).alias("expired"))


@query(views("molecules") + "SELECT topology, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM molecules WHERE lower(name) LIKE '%a%' GROUP BY 1")
def summaries_search_group(spark, sf_dir):
    m = derive.molecules(spark, sf_dir).where(F.lower("name").contains("a"))
    return m.groupBy("topology").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query(views("molecules", more="kept AS (SELECT seq_id, sha1(sequence) AS sum, 1 AS v FROM molecules WHERE seq_id % 3 <> 0), saved AS (SELECT seq_id, sha1(CASE WHEN seq_id % 7 = 0 THEN reverse(sequence) ELSE sequence END) AS sum, 2 AS v FROM molecules WHERE seq_id % 4 <> 0)") + "SELECT coalesce(k.seq_id, s.seq_id) AS seq_id, CASE WHEN s.seq_id IS NULL THEN 'kept' WHEN k.seq_id IS NULL THEN 'restored' WHEN k.sum = s.sum THEN 'same' ELSE 'copy' END AS outcome FROM kept k FULL JOIN saved s USING (seq_id)")
def backup_merge(spark, sf_dir):
    """Restoring a backup over a store: what is missing comes back, what differs becomes a copy."""
    m = derive.molecules(spark, sf_dir)
    kept = m.where("seq_id % 3 <> 0").select("seq_id", F.sha1("sequence").alias("a"))
    saved = m.where("seq_id % 4 <> 0").select("seq_id", F.sha1(F.when(F.col("seq_id") % 7 == 0, F.reverse("sequence")).otherwise(F.col("sequence"))).alias("b"))
    outcome = F.when(F.col("b").isNull(), "kept").when(F.col("a").isNull(), "restored").when(F.col("a") == F.col("b"), "same").otherwise("copy")
    return kept.join(saved, "seq_id", "full").select("seq_id", outcome.alias("outcome"))


@query("WITH RECURSIVE t AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey < 4 UNION ALL SELECT p.p_partkey, t.depth + 1 FROM t JOIN part p ON p.p_partkey // 4 = t.id AND p.p_partkey > 3 WHERE t.depth < 24) SELECT depth, count(*) AS n, min(id) AS least, max(id) AS most FROM t GROUP BY 1")
def lineage_recursive(spark, sf_dir):
    """Generations of a provenance tree in which molecule n was made from molecule n / 4."""
    return relations.quarter_generations(derive.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), 24)


@query("SELECT s_suppkey, CASE WHEN length(seq) = 0 THEN 'empty' WHEN NOT regexp_full_match(seq, '[ACGTURYKMBDHVSWNacgturykmbdhvswn]+') THEN 'letters' WHEN length(seq) < 15 THEN 'short' ELSE 'ok' END AS state FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN s_name ELSE substr(translate(md5(s_suppkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTRYSN'), 1, (s_suppkey % 30)::INT) END AS seq FROM supplier)")
def batch_validate(spark, sf_dir):
    """Rows of a batch table sorted into valid ones and reasons for refusal."""
    k = F.col("s_suppkey")
    word = F.substring(F.translate(F.md5(k.cast("string")), "0123456789abcdef", derive.CODES), F.lit(1), (k % 30).cast("int"))
    rows = derive.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 11 == 0, "").when(k % 5 == 0, F.col("s_name")).otherwise(word).alias("seq"))
    state = F.when(F.length("seq") == 0, "empty").when(~S.is_nucleotide(F.col("seq")), "letters").when(F.length("seq") < 15, "short").otherwise("ok")
    return rows.select("s_suppkey", state.alias("state"))


SETS = "o AS (SELECT seq_id, k, substr(sequence, k * 60 + 1, 4) AS overhang FROM molecules, range(8) t(k))"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _overhangs(spark, sf_dir):
    return derive.molecules(spark, sf_dir).select("seq_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring("sequence", k * 60 + 1, F.lit(4)))).alias("overhang"))


@query(views("molecules", more=SETS + f", p AS (SELECT *, least(overhang, {RC.format('overhang')}) AS pair FROM o), n AS (SELECT seq_id, pair, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT p.*, n.n, length(overhang) - length(translate(overhang, 'GC', '')) AS gc FROM p JOIN n USING (seq_id, pair))") + f"SELECT seq_id, overhang, 'palindrome' AS warning FROM q WHERE overhang = {RC.format('overhang')} UNION ALL SELECT seq_id, overhang, 'no GC' FROM q WHERE gc = 0 UNION ALL SELECT seq_id, overhang, 'all GC' FROM q WHERE gc = 4 UNION ALL SELECT seq_id, overhang, 'repeated' FROM q WHERE n > 1")
def overhang_warnings(spark, sf_dir):
    return cloning.overhang_warnings(_overhangs(spark, sf_dir), "seq_id")


COUNTS = "words AS (SELECT substr('ACGT', a::INT + 1, 1) || substr('ACGT', b::INT + 1, 1) || substr('ACGT', c::INT + 1, 1) || substr('ACGT', d::INT + 1, 1) AS w, a, b, c, d FROM range(4) x(a), range(4) y(b), range(4) z(c), range(4) v(d)), counts AS (SELECT t.w AS top, b.w AS bottom, CASE WHEN b.w = reverse(translate(t.w, 'ACGT', 'TGCA')) THEN 500 + t.a * 31 + t.d * 7 ELSE (t.a * 3 + b.b * 5 + t.c * 7 + b.d) % 11 END AS n FROM words t, words b)"


@query(views("molecules", more=SETS + ", " + COUNTS + f", ends AS (SELECT seq_id, overhang AS e FROM o UNION SELECT seq_id, {RC.format('overhang')} FROM o), seen AS (SELECT x.seq_id, x.e AS top, y.e AS bottom, n FROM ends x JOIN ends y USING (seq_id) JOIN counts c ON c.top = x.e AND c.bottom = y.e), per AS (SELECT seq_id, least(top, {RC.format('top')}) AS j, sum(CASE WHEN bottom = {RC.format('top')} THEN n ELSE 0 END) AS good, sum(n) AS total FROM seen GROUP BY 1, 2)") + "SELECT seq_id, floor(exp(sum(ln(good::DOUBLE / total))) * 1e6 + 0.5)::BIGINT AS millionths FROM per GROUP BY 1")
def fidelity_set(spark, sf_dir):
    """Ligation fidelity of each molecule's eight overhangs under a made-up count table."""
    base = spark.range(256).select(*[(F.floor(F.col("id") / 4**k) % 4).cast("int").alias(c) for k, c in enumerate("dcba")])
    word = F.concat(*[F.substring(F.lit("ACGT"), F.col(c) + 1, F.lit(1)) for c in "abcd"])
    t = base.select(word.alias("top"), *[F.col(c).alias(f"t{c}") for c in "abcd"])
    b = base.select(word.alias("bottom"), *[F.col(c).alias(f"b{c}") for c in "abcd"])
    n = F.when(F.col("bottom") == S.revcomp(F.col("top")), 500 + F.col("ta") * 31 + F.col("td") * 7).otherwise((F.col("ta") * 3 + F.col("bb") * 5 + F.col("tc") * 7 + F.col("bd")) % 11)
    counts = t.join(F.broadcast(b)).select("top", "bottom", n.alias("n"))  # the full table of 256 x 256 overhangs
    f = cloning.set_fidelity(_overhangs(spark, sf_dir).distinct(), counts, "seq_id")
    return f.select("seq_id", F.floor(F.col("fidelity") * 1e6 + 0.5).cast("bigint").alias("millionths"))


PARTS = "parts AS (SELECT seq_id, k AS part_id, substr(sequence, ((k * 5) % 6)::INT * 50 + 1, 4) AS \"left\", substr(sequence, ((k * 5 + 1) % 6)::INT * 50 + 1, 4) AS \"right\" FROM molecules, range(6) t(k))"


@query(views("molecules", more=PARTS + ", firsts AS (SELECT seq_id, \"left\" AS goal, \"right\" AS at_, 1 AS n, '0' AS path, [0::BIGINT] AS used, true AS clear FROM parts WHERE part_id = 0), fits AS (SELECT seq_id, \"left\", count(*) AS c, min(part_id) AS p, min(\"right\") AS r FROM parts GROUP BY 1, 2), walk AS (SELECT * FROM firsts UNION ALL SELECT w.seq_id, w.goal, f.r, w.n + 1, w.path || '-' || f.p::VARCHAR, list_append(w.used, f.p), w.clear AND f.c = 1 FROM walk w JOIN fits f ON f.seq_id = w.seq_id AND f.\"left\" = w.at_ WHERE w.n < 6 AND NOT list_contains(w.used, f.p)), last AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC) AS rn FROM walk)", recursive=True) + "SELECT seq_id, path AS \"order\", clear AND n = 6 AND at_ = goal AS closed FROM last WHERE rn = 1")
def goldengate_walk(spark, sf_dir):
    """The ring of six parts of each molecule, found by their overhangs."""
    at = lambda k: F.substring("sequence", (k * 5 % 6) * 50 + 1, F.lit(4))
    to = lambda k: F.substring("sequence", ((k * 5 + 1) % 6) * 50 + 1, F.lit(4))
    parts = derive.molecules(spark, sf_dir).select("seq_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(k.cast("bigint").alias("part_id"), at(k).alias("left"), to(k).alias("right")))).alias("p"))
    return cloning.ordered_assembly(parts.select("seq_id", "p.part_id", "p.left", "p.right"), "seq_id", 6)


@query("WITH p AS (SELECT r_regionkey AS slot, n_nationkey AS part, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3) SELECT a.n_name || '/' || b.n_name || '/' || c.n_name AS product FROM p a JOIN p b ON b.slot = 1 JOIN p c ON c.slot = 2 WHERE a.slot = 0")
def moclo_plan_cartesian(spark, sf_dir):
    """Every product of a three-slot plan: the parts of a slot are few, their product is the plan."""
    n = derive.table(spark, sf_dir, "nation")
    slot = lambda k, c: F.broadcast(n.where(F.col("n_regionkey") == k).select(F.col("n_name").alias(c)))
    return slot(0, "a").crossJoin(slot(1, "b")).crossJoin(slot(2, "c")).select(F.concat_ws("/", "a", "b", "c").alias("product"))


@query(views("molecules") + "SELECT seq_id, '>' || name || CASE WHEN topology = 'circular' THEN ' [topology=circular]' ELSE '' END || chr(10) || regexp_replace(sequence, '(.{70})', '\\1' || chr(10), 'g') || chr(10) AS record FROM molecules")
def fasta_write(spark, sf_dir):
    m = derive.molecules(spark, sf_dir)
    return m.select("seq_id", text.fasta_record(F.col("name"), F.col("sequence"), F.col("topology")).alias("record"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def strip_html(spark, sf_dir):
    plain = F.regexp_replace("html", "<[^>]*>", "")
    return derive.table(spark, sf_dir, "pages").select("page_id", F.char_length(plain).cast("bigint").alias("chars"), F.md5(plain).alias("digest"))


@query("SELECT r_name, n_name, count(*) AS suppliers, sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def suppliers_by_region(spark, sf_dir):
    t = lambda n: derive.table(spark, sf_dir, n)
    j = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
