"""Molecules, features, reads, primers and edits derived from the driver's tables.

The tables hold no sequences; these views make them from keys with md5 and translate, which Spark
and DuckDB evaluate alike. SQL holds the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.seq import let

LENGTH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """The driver's tables are single small files; what is made from a row is large, so the rows are
    dealt over all cores first (by key, as most operators group by it), several parts a core so that
    all end about together, and as many as shuffles have so that parts stay small as tables grow."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _bases(key, blocks: int, letters: str):
    parts = [F.md5(F.concat(key.cast("string"), F.lit(f"|{k}"))) for k in range(blocks)]
    return F.translate(F.concat(*parts), "0123456789abcdef", letters)


PLAIN, CODES = "ACGTACGTACGTACGT", "ACGTACGTACGTRYSN"


def molecules(spark: SparkSession, sf_dir: str, letters: str = PLAIN) -> DataFrame:
    """seq_id, name, alphabet, topology, length, sequence: 512 bases of each part.

    Spark guesses the size of what is made here from the few columns of the table it is made from, a
    small fraction, and would send all of it through the driver to join it. The hint holds for every
    join of what is made from molecules row by row or in groups; a smaller side may still be broadcast."""
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return part.select(
        F.col("p_partkey").alias("seq_id"),
        F.col("p_name").alias("name"),
        F.lit("nucleotide").alias("alphabet"),
        F.when(F.col("p_size") % 2 == 0, "circular").otherwise("linear").alias("topology"),
        F.lit(LENGTH).alias("length"),
        _bases(F.col("p_partkey"), 16, letters).alias("sequence"),
    ).hint("merge")


def _first_molecules(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """seq_id, sequence of the molecules that a key % most + 1 can name: a fixed number, so all tasks may hold them."""
    mol = molecules(spark, sf_dir).where(F.col("seq_id").between(2 - most, most))
    return F.broadcast(mol.select("seq_id", "sequence"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, seq_id, type, strand, start, end on the molecules, some across the origin."""
    line = table(spark, sf_dir, "lineitem")
    mol = molecules(spark, sf_dir).select("seq_id", "topology")
    start = (F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % LENGTH
    size = F.lit(9) + F.col("l_quantity").cast("int") * 3
    rows = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feature_id"),
        F.col("l_partkey").alias("seq_id"),
        F.when(F.col("l_linestatus") == "O", "CDS").otherwise("gene").alias("type"),
        F.when(F.col("l_returnflag") == "R", "reverse").otherwise("forward").alias("strand"),
        start.cast("bigint").alias("start"),
        (start + size).cast("bigint").alias("open_end"),
    )
    end = F.when(F.col("topology") == "circular", F.col("open_end")).otherwise(F.least("open_end", F.lit(LENGTH)))
    return rows.join(mol, "seq_id").select("feature_id", "seq_id", "topology", "type", "strand", "start", end.alias("end"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq_id, start, bases, quality (hex pairs): 96 bases of a molecule, every 17th turned."""
    orders = table(spark, sf_dir, "orders")
    mol = _first_molecules(spark, sf_dir, 97)
    rows = orders.select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 97 + 1).alias("seq_id"), (F.col("o_orderkey") * 13 % (LENGTH - 96)).cast("int").alias("start"))
    rows = _spread(rows, "read_id")
    hexes = F.concat(*[F.md5(F.concat(F.col("read_id").cast("string"), F.lit(f"#{k}"))) for k in range(6)])
    window = F.substring(F.col("sequence"), F.col("start") + 1, F.lit(96))
    turned = F.concat(*[F.translate(F.substring(window, k + 1, 1), "ACGT", "CGTA") if k % 17 == 16 else F.substring(window, k + 1, 1) for k in range(96)])
    return rows.join(mol, "seq_id").select("read_id", "seq_id", "start", turned.alias("bases"), hexes.alias("quality"))


def qualities(hexes):
    """Phred values 0 to 40 from hex pairs."""
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    values = lambda d: F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: (F.get(d, i * 2) * 16 + F.get(d, i * 2 + 1)) % 41)
    return let(F.transform(F.split(hexes, ""), digit), values)


def primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """primer_id, name, seq_id, sequence: 20 bases of a molecule, every other one turned round."""
    from strandwise.functions.seq import revcomp

    mol = _first_molecules(spark, sf_dir, 41)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("primer_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 41 + 1).alias("seq_id"))
    oligo = F.substring(F.col("sequence"), (F.col("primer_id") * 29 % (LENGTH - 20)).cast("int") + 1, F.lit(20))
    return rows.join(mol, "seq_id").select("primer_id", "name", "seq_id", F.when(F.col("primer_id") % 2 == 0, revcomp(oligo)).otherwise(oligo).alias("sequence"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ts, event_id, op, position, len: an edit log from the events."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 3 == 0, "delete").when(F.col("event_id") % 3 == 1, "insert").otherwise("replace")
    return e.select(F.col("user_id").alias("doc_id"), "ts", "event_id", op.alias("op"), (F.col("event_id") * 7 % 400).cast("int").alias("position"), (F.col("event_id") % 9 + 1).cast("int").alias("len"))


def _sql_bases(key: str, blocks: int, letters: str) -> str:
    parts = " || ".join(f"md5({key}::VARCHAR || '|{k}')" for k in range(blocks))
    return f"translate({parts}, '0123456789abcdef', '{letters}')"


_READ = " || ".join(f"translate(substr(w, {k + 1}, 1), 'ACGT', 'CGTA')" if k % 17 == 16 else f"substr(w, {k + 1}, 1)" for k in range(96))

SQL = {
    "molecules": f"SELECT p_partkey AS seq_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology, {LENGTH} AS length, {_sql_bases('p_partkey', 16, PLAIN)} AS sequence FROM part",
    "coded": f"SELECT p_partkey AS seq_id, {_sql_bases('p_partkey', 16, CODES)} AS sequence FROM part",
    "features": f"SELECT f.feature_id, f.seq_id, m.topology, f.type, f.strand, f.start, CASE WHEN m.topology = 'circular' THEN f.open_end ELSE least(f.open_end, {LENGTH}) END AS \"end\" FROM (SELECT l_orderkey * 10 + l_linenumber AS feature_id, l_partkey AS seq_id, CASE WHEN l_linestatus = 'O' THEN 'CDS' ELSE 'gene' END AS type, CASE WHEN l_returnflag = 'R' THEN 'reverse' ELSE 'forward' END AS strand, ((l_suppkey * 37 + l_linenumber * 11) % {LENGTH})::BIGINT AS start, ((l_suppkey * 37 + l_linenumber * 11) % {LENGTH} + 9 + trunc(l_quantity)::INT * 3)::BIGINT AS open_end FROM lineitem) f JOIN molecules m USING (seq_id)",
    "reads": f"SELECT read_id, seq_id, start, {_READ} AS bases, quality FROM (SELECT r.read_id, r.seq_id, r.start, substr(m.sequence, r.start + 1, 96) AS w, " + " || ".join(f"md5(r.read_id::VARCHAR || '#{k}')" for k in range(6)) + f" AS quality FROM (SELECT o_orderkey AS read_id, o_custkey % 97 + 1 AS seq_id, (o_orderkey * 13 % {LENGTH - 96})::INT AS start FROM orders) r JOIN molecules m USING (seq_id))",
    "bases": "SELECT read_id, seq_id, start, i, substr(bases, i + 1, 1) AS base, ('0x' || substr(quality, i * 2 + 1, 2))::INT % 41 AS q FROM reads, range(96) t(i)",
    "primers": f"SELECT p.primer_id, p.name, p.seq_id, CASE WHEN p.primer_id % 2 = 0 THEN reverse(translate(oligo, 'ACGT', 'TGCA')) ELSE oligo END AS sequence FROM (SELECT s.s_suppkey AS primer_id, s.s_name AS name, s.s_suppkey % 41 + 1 AS seq_id, substr(m.sequence, (s.s_suppkey * 29 % {LENGTH - 20})::INT + 1, 20) AS oligo FROM supplier s JOIN molecules m ON m.seq_id = s.s_suppkey % 41 + 1) p",
    "edits": "SELECT user_id AS doc_id, ts, event_id, CASE event_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'replace' END AS op, (event_id * 7 % 400)::INT AS position, (event_id % 9 + 1)::INT AS len FROM events",
}
NEEDS = {"features": ["molecules"], "reads": ["molecules"], "bases": ["molecules", "reads"], "primers": ["molecules"]}


def with_views(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause of the named views and those they need; more: further expressions."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + ([more] if more else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
