"""Nearest features, ranks and frames, cubes and pivots, JSON, dates, full-text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise import derive
from strandwise.derive import with_views as views
from strandwise.operators import relations as R
from strandwise.plans.registry import query


@query(views("reads", "features", more='f AS (SELECT seq_id, start, min(feature_id) AS feature_id FROM features GROUP BY 1, 2)') + "SELECT r.read_id, f.feature_id, (r.start - f.start)::BIGINT AS apart FROM reads r ASOF JOIN f ON r.seq_id = f.seq_id AND r.start >= f.start")
def nearest_feature(spark, sf_dir):
    """The last feature that starts at or before each read (as-of join)."""
    f = derive.features(spark, sf_dir).groupBy("seq_id", "start").agg(F.min("feature_id").alias("feature_id"))
    r = derive.reads(spark, sf_dir).select("read_id", "seq_id", "start")
    out = R.as_of(r, f, "seq_id", "start", ["feature_id"], "at")
    return out.select("read_id", "feature_id", (F.col("start") - F.col("at")).cast("bigint").alias("apart"))


@query(views("features") + "SELECT feature_id, seq_id, start, ntile(4) OVER w AS quarter, floor(percent_rank() OVER w * 1e6 + 0.5)::BIGINT AS rank_millionths, floor(cume_dist() OVER w * 1e6 + 0.5)::BIGINT AS dist_millionths, count(*) OVER (PARTITION BY seq_id ORDER BY start RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS within50 FROM (SELECT DISTINCT * FROM features) WINDOW w AS (PARTITION BY seq_id ORDER BY start, feature_id, \"end\", type, strand)")
def feature_ranks(spark, sf_dir):
    """Quartiles, relative ranks and neighbours within 50 bases, by molecule."""
    f = derive.features(spark, sf_dir).distinct()
    w = Window.partitionBy("seq_id").orderBy("start", "feature_id", "end", "type", "strand")
    millionths = lambda c: F.floor(c * 1e6 + 0.5).cast("bigint")
    near = F.count("*").over(Window.partitionBy("seq_id").orderBy("start").rangeBetween(-50, 0))
    return f.select("feature_id", "seq_id", "start", F.ntile(4).over(w).cast("bigint").alias("quarter"), millionths(F.percent_rank().over(w)).alias("rank_millionths"), millionths(F.cume_dist().over(w)).alias("dist_millionths"), near.alias("within50"))


@query(views("features") + 'SELECT type, strand, topology, count(*) AS n, max("end" - start)::BIGINT AS longest FROM features GROUP BY CUBE (type, strand, topology)')
def feature_cube(spark, sf_dir):
    return derive.features(spark, sf_dir).cube("type", "strand", "topology").agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query(views("features") + 'SELECT topology, type, count(*) AS n, sum("end" - start)::BIGINT AS bases FROM features GROUP BY ROLLUP (topology, type)')
def feature_rollup(spark, sf_dir):
    return derive.features(spark, sf_dir).rollup("topology", "type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(views("features") + "SELECT seq_id, count(*) FILTER (type = 'CDS' AND strand = 'forward') AS cds_forward, count(*) FILTER (type = 'CDS' AND strand = 'reverse') AS cds_reverse, count(*) FILTER (type = 'gene' AND strand = 'forward') AS gene_forward, count(*) FILTER (type = 'gene' AND strand = 'reverse') AS gene_reverse FROM features GROUP BY 1")
def feature_pivot(spark, sf_dir):
    f = derive.features(spark, sf_dir).withColumn("kind", F.concat_ws("_", F.lower("type"), "strand"))
    return f.groupBy("seq_id").pivot("kind", ["cds_forward", "cds_reverse", "gene_forward", "gene_reverse"]).count().na.fill(0)


@query(views("molecules") + "SELECT seq_id, to_json({'name': name, 'topology': topology, 'length': length, 'ends': [1, length], 'sequence': substr(sequence, 1, 12)})::VARCHAR AS fragment, name AS read_back, length AS last FROM molecules")
def json_fragments(spark, sf_dir):
    """Molecules as clipboard fragments in JSON, and fields read back from the text."""
    m = derive.molecules(spark, sf_dir)
    text = m.select("seq_id", R.fragment(["name", "topology", "length"], F.array(F.lit(1), F.col("length")), F.substring("sequence", 1, 12)).alias("fragment"))
    back = F.from_json("fragment", "name string, topology string, length int, ends array<int>, sequence string")
    return text.select("seq_id", "fragment", back["name"].alias("read_back"), F.element_at(back["ends"], -1).alias("last"))


@query("SELECT event_id, upper(strftime(ts, '%d-%b-%Y')) AS locus_date, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, (epoch_ms(date_trunc('day', ts)) // 86400000)::INT AS day FROM events")
def genbank_dates(spark, sf_dir):
    """Dates as a record's first line writes them, and read back."""
    e = derive.table(spark, sf_dir, "events")
    text = F.upper(F.date_format("ts", "dd-MMM-yyyy"))
    back = F.to_date(F.initcap(F.lower(text)), "dd-MMM-yyyy")
    return e.select("event_id", text.alias("locus_date"), F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month"), F.unix_date(back).alias("day"))


WORDS = "w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))) AS word FROM documents), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+')[1:6])) AS word FROM benchmark)"


@query("WITH " + WORDS + " SELECT item_id, doc_id, count(*) AS hits FROM q JOIN w USING (word) GROUP BY 1, 2 HAVING count(*) >= 3")
def text_search(spark, sf_dir):
    """Documents with three of the first words of a query or more, through an inverted index."""
    docs = derive.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = derive.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return R.text_search(docs, items, "doc_id", "item_id", first=6, least=3)


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_properties(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(views("molecules", more="r AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY seq_id) AS k, seq_id FROM (SELECT seq_id, split_part(name, ' ', 1) AS name FROM molecules))") + "SELECT seq_id, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS name FROM r")
def unique_names(spark, sf_dir):
    """Names made unique by a number, as aligned formats need them."""
    m = derive.molecules(spark, sf_dir).select("seq_id", F.split_part("name", F.lit(" "), F.lit(1)).alias("name"))
    return R.unique_names(m, "name", "seq_id").select("seq_id", "name")
