"""Texts that are written as files come back whole, whatever they are called."""

from linewright.session import fresh_path
from linewright.sources import ingest


def test_written_files_come_back(spark, monkeypatch):
    monkeypatch.setattr(ingest, "FOLDER_FILES", 3)
    monkeypatch.setattr(ingest, "READ_FOLDERS", 2)
    rows = [(f"f{i}.ts", f"text {i}\n") for i in range(20)]
    rows += [("same.py", "a"), ("same.py", "b"), (".hidden", "h"), ("_under", "u"), ("../up/ä b%@=+#.go", "x\r\ny"), ("empty", ""), ("null", None), ("zeros", "q\x00\x00")]
    path = fresh_path(spark, "text-test")
    folders = ingest.write_text_files(spark.createDataFrame(rows, "name string, content string").repartition(3), path)
    assert len(folders) > 2 * 3 and len(set(folders)) == len(folders)
    got = ingest.written_text_files(ingest.read_text_files(spark, folders, review_id=7)).collect()
    assert sorted((r.filename, r.content) for r in got) == sorted((n, c or "") for n, c in rows)
    assert len({r.file_id for r in got}) == len(rows) and {r.review_id for r in got} == {7}


def test_no_files_are_no_rows(spark):
    none = spark.createDataFrame([], "name string, content string")
    folders = ingest.write_text_files(none, fresh_path(spark, "text-test"))
    assert folders == [] and ingest.read_text_files(spark, folders).count() == 0
