"""Summaries of aligned sequences: consensus letters, conservation, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def letters(rows: DataFrame, key: str) -> DataFrame:
    """key, row_id, col, letter: a row for each column of each aligned row (key, row_id, aligned)."""
    return rows.select(key, "row_id", F.posexplode(F.filter(F.split(F.upper("aligned"), ""), lambda c: c != "")).alias("col", "letter"))


def column_summary(rows: DataFrame, key: str) -> DataFrame:
    """key, col, letter, share, mark: each column's most frequent letter (the least of equals; gaps only
    where there is nothing else), its share of the rows, and * where all rows have the same letter.
    Counted by letter before the shuffle."""
    size = rows.groupBy(key).agg(F.count("*").alias("rows"))
    n = letters(rows, key).groupBy(key, "col", "letter").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key, "col").orderBy(F.col("letter") == "-", F.desc("n"), "letter")
    best = n.withColumn("r", F.row_number().over(w)).where("r = 1").join(size.hint("merge"), key)
    return best.select(key, "col", "letter", (F.col("n") / F.col("rows")).alias("share"), F.when((F.col("n") == F.col("rows")) & (F.col("letter") != "-"), "*").otherwise(" ").alias("mark"))


def identities(rows: DataFrame, key: str) -> DataFrame:
    """key, a, b, same, both: for each pair of a set's rows the columns in which both have a letter, and
    those in which it is the same. Sets are as large as an alignment shows."""
    x = letters(rows, key).where("letter <> '-'").hint("merge")  # a row a letter, of which Spark guesses a row a text
    pairs = x.select(key, "col", F.col("row_id").alias("a"), F.col("letter").alias("x")).join(x.select(key, "col", F.col("row_id").alias("b"), F.col("letter").alias("y")), [key, "col"]).where("a < b")
    return pairs.groupBy(key, "a", "b").agg(F.sum((F.col("x") == F.col("y")).cast("bigint")).alias("same"), F.count("*").alias("both"))
