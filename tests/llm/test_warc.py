"""Archives written and read back, and archives that are broken."""

import hashlib

import pytest

from themeloom.llm import warc
from themeloom.plans.lineage import scratch_path

PAGES = "page_id long, url string, html string"


def round_trip(spark, df, **options):
    found = warc.archive_round_trip(df, scratch_path(spark, "warc"), warc.ArchiveOptions(**options))
    return sorted((tuple(r) for r in found.drop("payload").collect()), key=str)


def test_round_trip(spark, table):
    big = "<p>é</p>" * 400
    rows = [(i, f"http://x/{i}", f"<html>{i}" + "word " * (i % 500)) for i in range(400)]
    rows += [(1000 + i, "http://y", big) for i in range(20)]
    rows += [(2000, None, None), (2001, "http://z\r\nX: y", ""), (None, "u", big), (None, "v", "small"), (2002, "s", "small"),
             (3000, "long", "x" * 3_000_000), (1019, "again", big)]
    found = round_trip(spark, table(rows, PAGES).repartition(3), archive_bytes=100_000)
    expected = []
    for page, url, html in rows:
        payload = (html or "").encode()
        keeper = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(payload) >= 1000 else page
        revisit = page != keeper
        shown = url.replace("\r\n", "%0D%0A") if url else None
        expected.append((page, shown, "revisit" if revisit else "response", keeper if revisit else None, hashlib.sha1(payload).hexdigest(), len(payload)))
    assert found == sorted(expected, key=str)


def test_archives_are_read_side_by_side(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id), 256), 40) AS html").repartition(4)
    folder, options = scratch_path(spark, "warc"), warc.ArchiveOptions(archive_bytes=100_000)
    manifest = warc.write_archives(warc.with_revisits(pages, options), folder, options)
    archives = manifest.count()
    assert archives >= 4
    tasks = {r.t for r in warc.read_archives(manifest).selectExpr("spark_partition_id() AS t").distinct().collect()}
    assert len(tasks) == min(archives, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_empty(spark, table):
    assert round_trip(spark, table([], PAGES)) == []


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    df = spark.createDataFrame([(i, "u", f"payload {i} " * 50) for i in range(300)], PAGES).coalesce(1)
    rows = warc.with_revisits(df, warc.ArchiveOptions()).coalesce(1)
    (row,) = warc.write_archives(rows, scratch_path(spark, "warc"), warc.ArchiveOptions()).collect()
    system, name = warc._file_system(row.path)
    with system.open_input_stream(name, compression=None) as file:
        return file.read()


def read(tmp_path, data):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(data)
    return [r["page_id"] for chunk in (7, 1 << 20) for r in warc.archive_records(str(path), chunk)]


def test_dictionary_and_frames(tmp_path, archive):
    import struct

    import zstandard

    magic, size = struct.unpack("<II", archive[:8])
    assert magic == 0x184D2A5D and size > 0
    assert zstandard.ZstdCompressionDict(archive[8 : 8 + size]).dict_id()
    assert sorted(read(tmp_path, archive)) == sorted(2 * list(range(300)))


@pytest.mark.parametrize("broken", ["cut", "head", "flip", "dictionary"])
def test_broken_archives_are_refused(tmp_path, archive, broken):
    data = {
        "cut": archive[:-3],
        "head": b"junk" + archive[4:],
        "flip": archive[:-12] + bytes([archive[-12] ^ 255]) + archive[-11:],
        "dictionary": archive[:100],
    }[broken]
    with pytest.raises(ValueError):
        read(tmp_path, data)


def test_wrong_lengths_are_refused():
    record = {"page_id": 1, "url": "u", "payload": b"abc", "digest": hashlib.sha1(b"abc").hexdigest(), "size": 3, "refers_to": None}
    good = warc.record_bytes(record, warc.ArchiveOptions())
    assert warc.parsed(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abcd"), good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)
