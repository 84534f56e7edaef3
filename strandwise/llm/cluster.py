"""What the operators share on a cluster: checkpoints, key ranges and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under the cluster's shared checkpoint folder. What is written there stays
    until that folder is cleared: results read it lazily."""
    return f"{checkpoint_dir(spark)}/strandwise-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session in one process (local[n], as in
    tests) may leave it unset and gets a folder of its own."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(held)
    return held


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there and a
    lost executor costs no more than the tasks that read the table."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the columns has."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """The smallest label that each vertex of ``edges`` (a, b: bigint) can reach: rows (v, label).

    Alternating large-star and small-star steps. Each keeps at most as many edges as it got and
    every step is an aggregate (combined before the shuffle) and a plain equi-join, which Spark
    splits when one vertex holds many edges. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = now.checkpoint()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
        # a star forest: no vertex is both a leaf and a centre, and no leaf has two centres
        leaves = new.groupBy("a").agg(F.count("*").alias("n"))
        loose = leaves.where("n > 1").select("a").limit(1).unionByName(new.join(new.select(F.col("b").alias("a")), "a", "left_semi").select("a").limit(1))
        if not loose.head(1):
            return new.select(F.col("a").alias("v"), F.col("b").alias("label"))
        now = new


def key_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending values of a bigint column that split its rows about evenly."""
    if n < 2:
        return []
    found = df.select(F.percentile_approx(column, [k / n for k in range(1, n)], 10 * n).alias("q")).head()[0] or []
    return sorted(set(found))


def bucket_of(column: str, bounds: list[int]) -> Column:
    """How many of the bounds a value reaches: the number of its key range.

    A balanced CASE: about log2(n) comparisons a row, in generated code."""
    x = F.col(column)

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))



def let(value: Column, f) -> Column:
    """f(value), with the value computed once: as a lambda's variable no rule of the optimizer can
    copy its expression to every place (or into an inner lambda) where f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
