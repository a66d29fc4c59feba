"""The registry of formats, archives as streams, and odd files."""

from pyspark.sql import functions as F

from tariffloom.plans import archives
from tariffloom.sources import files


def test_registered_reader(spark, monkeypatch):
    monkeypatch.setattr(files, "READERS", dict(files.READERS))
    assert files.formats() == ["docx", "xlsx"]

    @files.reads("pdf")
    def lines(content):
        return [("page", k, [line], None) for k, line in enumerate(content.decode().split("\n")[1:])]

    assert files.formats() == ["docx", "pdf", "xlsx"]
    rows = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1.4\nx\ny")), ("b.xls", bytearray(b"?")), ("c.docx", bytearray(b"PK\x03\x04"))], "name string, content binary")
    assert [(r.file, r.row_idx, r.cells) for r in files.tables(rows).collect()] == [("a.pdf", 0, ["x"]), ("a.pdf", 1, ["y"])]


def test_stream_reads_what_a_batch_reads(spark, tmp_path):
    made = archives.archives(spark, "/root/testdata/sf0.001").limit(3)
    for r in made.collect():
        (tmp_path / r.path).write_bytes(bytes(r.content))
    schema = spark.read.format("binaryFile").load(f"file://{tmp_path}").schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 1).load(f"file://{tmp_path}")
    rows = lambda source: files.tables(files.zip_entries(source)).select("archive", "file", "table_id", "row_idx", F.array_join("cells", "|").alias("cells"))
    query = rows(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = sorted(map(tuple, rows(files.binary(spark, f"file://{tmp_path}/*.zip")).collect()))
    assert batch and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == batch


def test_catalogue_without_header_and_long_files(spark):
    book = archives.workbook({"sheet1": [["x", "y"], ["a", "b"]]})
    empty, padded = archives.workbook({"sheet1": []}), archives.workbook({"sheet9": [["Код", "Услуга"], [7, "ОАК"], [8, " "]], "sheet1": [["name"], ["no"]]} | {f"sheet{k}": [[f"{k} {n}" * 40 for n in range(60)]] for k in range(10, 40)})
    assert len(padded) > 10_000
    rows = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.xlsx", bytearray(empty)), ("c.xlsx", bytearray(padded)), ("d.xlsx", bytearray(b""))], "name string, content binary")
    assert [(r.file, r.service_name, r.code, r.synonyms, r.category) for r in files.catalogue_sheets(rows).collect()] == [("c.xlsx", "ОАК", 7, [], None)]
