"""Readers and writers, and the streams, on small files."""

from pyspark.sql import functions as F

from strandwise.sources import text
from strandwise.streaming import edits


def test_fasta_round_trip(spark, tmp_path):
    mol = spark.createDataFrame([("a", "ACGT" * 50, "circular"), ("b", "AC", "linear")], "name string, sequence string, topology string")
    text.write_fasta(mol.coalesce(1), str(tmp_path / "out"))
    back = {r.name: r for r in text.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back["a"].sequence == "ACGT" * 50 and back["a"].topology == "circular" and back["a"].error is None
    assert back["b"].sequence == "AC" and back["b"].topology == "linear"


def test_fasta_problems(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one some words\nAC GT\n1 AC\n>\nAC\n>three\n")
    rows = text.read_fasta(spark, str(tmp_path / "x.fa")).collect()
    assert [(r.name, r.sequence, r.error) for r in rows] == [("one", "ACGTAC", None), ("", "AC", "no name"), ("three", "", "no sequence")]
    assert rows[0].description == "some words"


def test_fastq(spark, tmp_path):
    (tmp_path / "x.fq").write_bytes(b"@r1 lane 1\r\nACGT\r\n+\r\nII#!\r\n@r2\nAC\n+r2\nI\n")
    good, bad = text.read_fastq(spark, str(tmp_path / "x.fq")).collect()
    assert (good.name, good.description, good.bases, good.quality, good.error) == ("r1", "lane 1", "ACGT", [40, 40, 2, 0], None)
    assert bad.error == "lengths differ"


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "insert", 0, 2, "AC"), (1, "2024-01-01 00:00:01", 2, "insert", 1, 1, "G"), (1, "2024-01-01 02:00:00", 3, "delete", 0, 1, None), (2, "2024-01-01 00:00:05", 4, "insert", 0, 1, "T")]
    df = spark.createDataFrame(rows, "doc_id bigint, ts string, event_id bigint, op string, position int, len int, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def ended(name, frame, mode):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    docs = {r.doc_id: r for r in ended("folded", edits.fold_documents(stream), "update")}
    assert (docs[1].version, docs[1].sequence, docs[2].sequence) == (3, "GC", "T")
    windows = ended("windows", edits.edits_per_window(stream), "complete")
    assert sum(r.edits for r in windows) == 4 and {r.edits for r in windows if r.doc_id == 1} == {2, 1}
    assert sum(r.edits for r in ended("sessions", edits.edit_sessions(stream), "complete")) == 4
