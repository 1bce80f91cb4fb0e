"""One file per document, staged by tasks and committed as a whole."""
import os

import pytest
from pyspark.sql import functions as F

from mise.sources import document_files as DF

SCHEMA = "page_id bigint, filename string, format string, body string"


def files_of(path):
    return {f: open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def test_files_hold_the_last_documents(spark, tmp_path):
    rows = [(1, "a.md", "md", "old"), (9, "a.md", "md", "new é🙂"), (5, "a.md", "md", "mid"), (2, "b.rst", "rst", "b\n"), (3, "c.md", "md", " \n\t"), (4, "d.md", "md", None),
            (7, "b.rst", "rst", "  ")] + [(k, f"n{k}.md", "md", f"body {k}") for k in range(200)]
    path = str(tmp_path / "out")
    DF.write_document_files(spark.createDataFrame(rows, SCHEMA).repartition(7), path)
    want = {"a.md": "new é🙂", "b.rst": "b\n"} | {f"n{k}.md": f"body {k}" for k in range(200)}
    assert files_of(path) == want
    assert {r.filename: r.body for r in DF.scan_document_files(spark, path).collect()} == want
    assert len(os.listdir(path)) <= DF.SHARDS and not any(DF.STAGING in d for d in os.listdir(path))


def test_overwrite_replaces_and_append_refuses(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a.md", "md", "one"), (2, "b.md", "md", "two")], SCHEMA)
    DF.write_document_files(df, path, shards=3)
    with pytest.raises(Exception, match="holds documents"):
        DF.write_document_files(df.where("page_id = 2"), path, shards=3, overwrite=False)
    assert files_of(path) == {"a.md": "one", "b.md": "two"}
    DF.write_document_files(df.where("page_id = 2").withColumn("body", F.lit("again")), path, shards=3)
    assert files_of(path) == {"b.md": "again"}


@pytest.mark.parametrize("name", ["x/y.md", "..", ""])
def test_a_failed_job_leaves_nothing(spark, tmp_path, name):
    path = str(tmp_path / "out")
    rows = [(k, f"n{k}.md", "md", "x") for k in range(50)] + [(99, name, "md", "bad")]
    with pytest.raises(Exception, match="not a file name"):
        DF.write_document_files(spark.createDataFrame(rows, SCHEMA), path)
    assert files_of(path) == {}
    DF.write_document_files(spark.createDataFrame(rows[:50], SCHEMA), path)
    before = files_of(path)
    with pytest.raises(Exception, match="not a file name"):
        DF.write_document_files(spark.createDataFrame(rows, SCHEMA), path)
    assert files_of(path) == before and len(before) == 50


def test_an_empty_table_writes_no_files(spark, tmp_path):
    path = str(tmp_path / "out")
    DF.write_document_files(spark.createDataFrame([], SCHEMA), path)
    assert files_of(path) == {}


def test_another_attempt_of_a_task_is_not_seen(tmp_path):
    import pyarrow as pa
    path = str(tmp_path / "out")
    w = DF._Writer(path, True)
    batch = pa.RecordBatch.from_pydict({"shard": ["00"], "filename": ["a.md"], "body": ["x"]})
    w.write(iter([batch]))          # an attempt whose executor was lost after writing
    kept = w.write(iter([batch]))
    w.commit([kept, None])
    assert files_of(path) == {"a.md": "x"} and os.listdir(path) == ["00"]


def test_a_task_that_outlives_its_job_writes_nothing(tmp_path):
    import pyarrow as pa
    path = str(tmp_path / "out")
    w = DF._Writer(path, True)

    def batches():
        yield pa.RecordBatch.from_pydict({"shard": ["00"], "filename": ["a.md"], "body": ["x"]})
        w.abort([])
        yield pa.RecordBatch.from_pydict({"shard": ["01"], "filename": ["b.md"], "body": ["y"]})
    with pytest.raises(OSError):
        w.write(batches())
    with pytest.raises(OSError):
        w.write(batches())
    assert files_of(path) == {} and os.listdir(path) == []
