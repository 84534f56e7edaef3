"""FASTA and FASTQ: lines in, records out.

Reading uses Spark's text reader with a record separator, so large files are split between tasks;
every record comes back with its problems in ``error`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import seq as S


def fasta_record(name: Column, sequence: Column, topology: Column, width: int = 70) -> Column:
    mark = F.when(topology == "circular", " [topology=circular]").otherwise("")
    return F.concat(F.lit(">"), name, mark, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, topology, sequence, error."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    head = F.trim(F.substring_index(F.regexp_replace(body, "\r", ""), "\n", 1))
    bases = S.normalise(F.regexp_replace(body, r"^[^\n]*\n?", ""))
    rows = raw.select(head.alias("head"), bases.alias("sequence"))
    error = F.when(F.col("head") == "", "no name").when(F.col("sequence") == "", "no sequence").when(~F.col("sequence").rlike("^[A-Za-z*-]*$"), "letters")
    return rows.select(
        F.substring_index("head", " ", 1).alias("name"),
        F.trim(F.regexp_replace("head", r"^\S*", "")).alias("description"),
        F.when(F.col("head").contains("[topology=circular]"), "circular").otherwise("linear").alias("topology"),
        "sequence",
        error.alias("error"),
    )


def write_fasta(mol: DataFrame, path: str) -> None:
    record = F.regexp_replace(fasta_record(F.col("name"), F.col("sequence"), F.col("topology")), "\n+$", "")
    mol.select(record.alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """name, description, bases, quality (array), error. Four-line records; a file is read whole by
    one task because a quality line may begin with the mark of a name."""
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x.isNotNull())
    rows = files.select(S.let(lines, lambda v: F.transform(S.positions(F.floor((F.size(v) + 3) / 4).cast("int")), lambda i: F.slice(v, i * 4 + 1, 4))).alias("r")).select(F.explode("r").alias("r")).where("size(r) > 1 OR trim(r[0]) <> ''")
    at = lambda k: F.coalesce(F.get("r", F.lit(k)), F.lit(""))
    error = (
        F.when(~at(0).startswith("@"), "no @ line")
        .when(~at(2).startswith("+"), "no + line")
        .when(F.length(at(1)) != F.length(at(3)), "lengths differ")
        .when(at(3).rlike(r"[^!-~]"), "quality letters")
        .when((F.length(at(2)) > 1) & (F.substring(at(2), F.lit(2), F.length(at(2))) != F.substring(at(0), F.lit(2), F.length(at(0)))), "names differ")
    )
    head = F.substring(at(0), F.lit(2), F.length(at(0)))
    return rows.select(F.substring_index(head, " ", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), at(1).alias("bases"), S.phred(at(3), offset).alias("quality"), error.alias("error"))


def fastq_record(name: Column, bases: Column, quality: Column, offset: int = 33) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), bases, F.lit("\n+\n"), F.array_join(F.transform(quality, lambda q: F.char(q + offset)), ""))
