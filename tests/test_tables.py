"""Delimited tables, spreadsheets, aligned formats, and streams with timers, joins and sinks."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from strandwise.sources import delimited
from strandwise.streaming import edits


def test_oligo_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Primer Name, Seq ,note\nP1,"AC GT\nAC",x\n,ACGT,y\nP3,,z\nP4,AC!T,\n')
    rows = delimited.read_oligos(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.name, r.sequence, r.error) for r in rows] == [("P1", "ACGTAC", None), ("", "ACGT", "no name"), ("P3", "", "no bases"), ("P4", "AC!T", "letters")]
    with pytest.raises(ValueError):
        delimited.read_oligos(spark, str(tmp_path / "a.csv"), sep="\t")
    df = spark.createDataFrame([("=cmd", "ACGT", 1), ("ok", 'A"C', 2)], "name string, sequence string, n int")
    delimited.write_table(df.coalesce(1), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()
    assert {(r.name, r.sequence, r.n) for r in back} == {("'=cmd", "ACGT", "1"), ("ok", 'A"C', "2")}


def workbook(path):
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>seq</t></is></c></row><row r="3"><c r="A3"><v>4.5</v></c><c r="C3" t="s"><v>1</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><r><t>AC</t></r><r><t>GT</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", head + rows + "</sheetData></worksheet>")


def test_sheets(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = delimited.read_sheets(spark, str(tmp_path)).collect()
    good = sorted((r.sheet, r.row, r.cells) for r in rows if r.error is None)
    assert good == [("sheet1", 1, ["name", None, "seq"]), ("sheet1", 3, ["4.5", None, "ACGT"])]
    assert len(rows) == 3 and any("BadZipFile" in (r.error or "") for r in rows)


def test_clustal(spark):
    df = spark.createDataFrame([(1, "b b", "AC-T"), (1, "a", "ACGT")], "grp int, name string, aligned string")
    lines = delimited.clustal_texts(df, "grp").head().text.split("\n")
    assert lines[0].startswith("CLUSTAL") and lines[2:5] == ["a     ACGT", "b_b   AC-T", "      ** *"]


T0 = datetime.datetime(2024, 1, 1, 12)


def log(rows):
    return [(d, T0 + datetime.timedelta(seconds=s), i) for d, s, i in rows]


@pytest.fixture
def stream(spark, tmp_path):
    """Two files, read one after the other: the second moves the watermark past the first."""
    schema = "doc_id bigint, ts timestamp, event_id bigint"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[(1, 0, 1), (1, 1, 2), (1, 10, 3), (2, 5, 4)], [(3, 7200, 5)], [(1, 7300, 6), (3, 14400, 7)]]):
        spark.createDataFrame(log(rows), schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        part = next((tmp_path / f"part{k}").glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ended(spark, name, frame, tmp_path, mode="append"):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_debounce(spark, stream, tmp_path):
    rows = ended(spark, "quiet", edits.debounced(stream), tmp_path)
    assert {(r.doc_id, r.event_id, r.edits) for r in rows} >= {(1, 2, 2), (1, 3, 1), (2, 4, 1)}


def test_expiry(spark, stream, tmp_path):
    rows = ended(spark, "expired", edits.expired_documents(stream, 3_600_000), tmp_path)
    ms = lambda s: int((T0 - datetime.datetime(1970, 1, 1)).total_seconds() * 1000) + s * 1000
    assert {(r.doc_id, r.edits, r.last_ms) for r in rows} >= {(1, 3, ms(10)), (2, 1, ms(5))}


def test_saved_edits_and_batches(spark, stream, tmp_path):
    saves = stream.select((F.col("event_id") + 100).alias("save_id"), "doc_id", (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("saved_at"))
    rows = ended(spark, "saved", edits.saved_edits(stream, saves), tmp_path)
    assert {(r.event_id, r.save_id) for r in rows} >= {(1, 101), (1, 102), (2, 101), (2, 102), (3, 103), (4, 104), (1, 103)}
    edits.write_batches(stream, str(tmp_path / "batches"), str(tmp_path / "sink")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "batches")).count() == 7
