"""Small answers about ranges, names, locations and qualities."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strandwise import derive
from strandwise.derive import with_views as views
from strandwise.functions import seq as S
from strandwise.plans.registry import query

N = derive.LENGTH


def one_based_end(end: Column, length: Column) -> Column:
    """The last base of a non-empty range as people write it, folded past the origin."""
    return F.when(end > length, end - length).otherwise(end)


def short_way(offset: Column, length: Column) -> Column:
    """An offset round a circle, folded into (-length / 2, length / 2]."""
    d = F.pmod(offset, length)
    return F.when(d * 2 > length, d - length).otherwise(d)


def location_text(start: Column, end: Column, length: Column, strand: Column) -> Column:
    """A range as a flat file writes it; across the origin it is a join of two."""
    span = lambda a, b: F.when(b - a == 1, b.cast("string")).otherwise(F.concat_ws("..", (a + 1).cast("string"), b.cast("string")))
    plain = F.when(end > length, F.concat(F.lit("join("), span(start, length), F.lit(","), span(F.lit(0), end - length), F.lit(")"))).otherwise(span(start, end))
    return F.when(strand == "reverse", F.concat(F.lit("complement("), plain, F.lit(")"))).otherwise(plain)


@query(views("features") + f"SELECT feature_id, \"end\" - start AS size, \"end\" > {N} AS wraps, (start >= 0 AND \"end\" >= start AND CASE WHEN topology = 'linear' THEN \"end\" <= {N} ELSE start < {N} AND \"end\" - start <= {N} END) AS valid, CASE WHEN \"end\" > {N} THEN \"end\" - {N} ELSE \"end\" END AS last_base FROM features")
def range_scalars(spark, sf_dir):
    s, e, n = F.col("start"), F.col("end"), F.lit(N)
    valid = (s >= 0) & (e >= s) & F.when(F.col("topology") == "linear", e <= n).otherwise((s < n) & (e - s <= n))
    return derive.features(spark, sf_dir).select("feature_id", (e - s).alias("size"), (e > n).alias("wraps"), valid.alias("valid"), one_based_end(e, n).alias("last_base"))


@query(views("features", more=f"d AS (SELECT feature_id, (((300 - start) % {N}) + {N}) % {N} AS d FROM features)") + f"SELECT feature_id, (CASE WHEN d * 2 > {N} THEN d - {N} ELSE d END)::BIGINT AS offset_ FROM d")
def short_way_round(spark, sf_dir):
    return derive.features(spark, sf_dir).select("feature_id", short_way(F.lit(300) - F.col("start"), F.lit(N)).alias("offset_"))


SPAN = "CASE WHEN {b} - {a} = 1 THEN ({b})::VARCHAR ELSE ({a} + 1)::VARCHAR || '..' || ({b})::VARCHAR END"
PLAIN = f"CASE WHEN e > {N} THEN 'join(' || {SPAN.format(a='start', b=str(N))} || ',' || {SPAN.format(a='0', b=f'(e - {N})')} || ')' ELSE {SPAN.format(a='start', b='e')} END"


@query(views("features", more=f"l AS (SELECT feature_id, strand, {PLAIN} AS t FROM (SELECT *, \"end\" AS e FROM features) WHERE e > start)") + "SELECT feature_id, CASE WHEN strand = 'reverse' THEN 'complement(' || t || ')' ELSE t END AS location FROM l")
def location_texts(spark, sf_dir):
    f = derive.features(spark, sf_dir).where("end > start")
    return f.select("feature_id", location_text(F.col("start"), F.col("end"), F.lit(N), F.col("strand")).alias("location"))


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 1013) || ' bp' AS label FROM orders")
def length_labels(spark, sf_dir):
    return derive.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.format_number(F.col("o_orderkey") * 1013, 0), F.lit(" bp")).alias("label"))


@query(views("features", more="p AS (SELECT seq_id, start AS s, least(\"end\", 512) AS e FROM features WHERE \"end\" > start UNION ALL SELECT seq_id, 0, \"end\" - 512 FROM features WHERE \"end\" > 512), m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS new, row_number() OVER (PARTITION BY seq_id ORDER BY s, e) AS rn FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY rn) AS run FROM m)") + 'SELECT seq_id, min(s) AS start, max(e) AS "end" FROM r GROUP BY seq_id, run')
def covered_runs(spark, sf_dir):
    """The stretches of each molecule that any feature covers, merged."""
    from strandwise.operators.intervals import pieces

    p = derive.features(spark, sf_dir).where("end > start").select("seq_id", F.inline(pieces(F.col("start"), F.col("end"), F.lit(N)))).where("e > s")
    w = Window.partitionBy("seq_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    return p.groupBy("seq_id", "run").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("run")


@query(views("bases") + "SELECT read_id, count(*) FILTER (q >= 20) AS confident, min(q) AS worst, sum(q)::BIGINT AS total FROM bases GROUP BY 1")
def quality_summary(spark, sf_dir):
    q = derive.qualities(F.col("quality"))
    r = derive.reads(spark, sf_dir).select("read_id", q.alias("q"))
    return r.select("read_id", F.size(F.filter("q", lambda x: x >= 20)).cast("bigint").alias("confident"), F.array_min("q").alias("worst"), F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(views("molecules", more="s AS (SELECT seq_id, sequence AS t FROM molecules WHERE topology = 'circular' UNION ALL SELECT seq_id, reverse(translate(sequence, 'ACGT', 'TGCA')) FROM molecules WHERE topology = 'circular'), least_ AS (SELECT seq_id, min(substr(t, i + 1) || substr(t, 1, i)) AS r FROM s, range(512) k(i) GROUP BY 1)") + "SELECT seq_id, replace(replace(rtrim(to_base64(unhex(sha1(r || ';' || reverse(translate(r, 'ACGT', 'TGCA'))))), '='), '+', '-'), '/', '_') AS checksum FROM least_")
def seguid_circular(spark, sf_dir):
    """The checksum of a double-stranded circle: the same for either strand and any origin."""
    s = derive.molecules(spark, sf_dir).where("topology = 'circular'").select("seq_id", F.col("sequence").alias("t"))
    r = F.least(S.minimal_rotation(F.col("t")), S.minimal_rotation(S.revcomp(F.col("t"))))
    return s.select("seq_id", S.let(r, lambda x: S.base64url(F.unhex(F.sha1(F.concat_ws(";", x, S.revcomp(x)))))).alias("checksum"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, count(DISTINCT user_id) AS documents FROM events GROUP BY 1, 2")
def edits_by_hour(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("documents"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def conversation_steps(spark, sf_dir):
    c = derive.table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", "turns", "last_turn", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))
