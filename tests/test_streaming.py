import tempfile

import pytest

from themeloom.streaming.cleaning import clean_and_filter, clean_stream

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("files", [1, 3])
def test_same_as_without_a_stream(spark, files):
    """A table may be a folder of part files."""
    folder = tempfile.mkdtemp(prefix="run-")
    rows = [(i, f"Dear bank {i}, " + "you charged XXXX me twice " * (i % 5)) for i in range(60)]
    rows += [(None, "no key here " * 9), (7, rows[7][1]), (61, None), (62, "x" * 50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(files).write.parquet(f"{folder}/docs.parquet")
    spark.createDataFrame([(99, "another table " * 9)], SCHEMA).write.parquet(f"{folder}/more_docs.parquet")
    found = clean_stream(spark, folder, "docs", "doc_id", "text")
    expected = clean_and_filter(docs, "doc_id", "text")
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    assert found.schema == expected.schema and not found.isEmpty()


def test_single_file(spark):
    found = clean_stream(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    expected = clean_and_filter(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text")
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_nothing_left(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame([(1, "short")], SCHEMA).write.parquet(f"{folder}/docs.parquet")
    assert clean_stream(spark, folder, "docs", "doc_id", "text").count() == 0
