import os
import tempfile

import pytest

from themeloom.sources import delimited

SCHEMA = delimited.string_schema(["id", "product", "narrative"])
ROWS = [
    ("1", "A", "plain"),
    ("2", "B", 'quoted "word", comma'),
    ("3", "A", "two\nlines, and\n\nmore"),
    ("4", None, "  blanks around  "),
    ("5", "C", "ends with quote\""),
    ("6", "C", "\"\nstarts"),
]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


def as_tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, folder):
    path = os.path.join(folder, "out")
    delimited.write_csv(spark.createDataFrame(ROWS, SCHEMA), path)
    assert as_tuples(delimited.read_csv(spark, path)) == sorted(ROWS, key=lambda r: r[0])
    assert as_tuples(delimited.read_csv_by_line(spark, path, SCHEMA)) == sorted(ROWS, key=lambda r: r[0])


def test_huge_file_in_many_blocks(spark, folder):
    """One file, read in small pieces that begin and end inside quoted fields."""
    path = os.path.join(folder, "in.csv")
    rows = [(str(i), f"p{i % 3}", f"line one of {i}\nsays \"x, y\"\nend\n" + "filler " * (i % 40)) for i in range(400)]
    with open(path, "w", newline="") as f:
        f.write("ID,Product,Narrative\n")
        for r in rows:
            f.write(",".join('"' + v.replace('"', '""') + '"' for v in r) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        whole = delimited.read_csv(spark, path)
        pieces = delimited.read_csv_by_line(spark, path, SCHEMA)
        lines = spark.read.text(path)
        assert lines.rdd.getNumPartitions() > 5
        assert whole.columns == pieces.columns
        assert as_tuples(pieces) == as_tuples(whole) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
