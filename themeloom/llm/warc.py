"""Web archives in Zstandard with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; every record
is a frame of its own, so a reader can start at any of them. Records whose
payload is stored under another page are revisits: they keep the HTTP headers
and name the page that has the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import text_or_empty
from themeloom.plans.lineage import cut

DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"


@dataclass(frozen=True)
class ArchiveOptions:
    """``sample`` records, at most ``sample_bytes``, of each task train its dictionary.

    An archive is closed beyond ``archive_bytes`` of compressed data. Payloads of
    fewer than ``least_bytes`` are always stored.
    """

    least_bytes: int = 1000
    sample: int = 200
    sample_bytes: int = 2_000_000
    dictionary_bytes: int = 32_768
    archive_bytes: int = 64_000_000
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, options: ArchiveOptions) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: ``refers_to`` is null for stored payloads.

    Payloads are told apart by length and SHA-1. Groups are counted with partial
    sums; the join back is a sort-merge join whose hot payloads Spark splits.
    """
    rows = pages.select("page_id", "url", F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    groups = (
        rows.where(F.col("size") >= options.least_bytes)
        .groupBy(F.col("digest").alias("_digest"), F.col("size").alias("_size"))
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
    )
    joined = rows.join(groups, (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left")
    return joined.select(
        "page_id",
        "url",
        F.when(F.col("keeper").isNull() | F.col("page_id").eqNullSafe(F.col("keeper")), F.col("payload")).alias("payload"),
        "digest",
        "size",
        F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, folder: str, options: ArchiveOptions) -> DataFrame:
    """Write the records below ``folder``; ``(path, records, bytes)`` per archive.

    Every task writes files of new names, so a task that runs again after a loss
    cannot disturb anything: only files named in the (cut) result count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for b in batches for r in b.to_pylist())
        for path, count, size in _archives(records, folder, options):
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
                ["path", "records", "bytes"],
            )

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def _archives(records: Iterator[dict], folder: str, options: ArchiveOptions) -> Iterator[tuple[str, int, int]]:
    import zstandard

    first, size = [], 0
    for record in records:
        first.append(record)
        size += record["size"]
        if len(first) >= options.sample or size >= options.sample_bytes:
            break
    if not first:
        return
    try:
        samples = [r["payload"] for r in first if r["payload"]]
        dictionary = zstandard.train_dictionary(options.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        dictionary = b""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=options.level, dict_data=shared)
    system, base = _file_system(folder)
    system.create_dir(base, recursive=True)
    waiting = (r for part in (first, records) for r in part)
    record = next(waiting, None)
    while record is not None:
        name = f"{uuid.uuid4().hex}.warc.zst"
        count = 0
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
            out.write(packer.compress(_information(name, options)))
            while record is not None and out.tell() < options.archive_bytes:
                out.write(packer.compress(record_bytes(record, options)))
                count += 1
                record = next(waiting, None)
            size = out.tell()
        yield f"{folder}/{name}", count, size


def _file_system(folder: str):
    from pyarrow import fs

    if ":" not in folder:
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    """Header lines; line breaks and other controls in values are percent-encoded."""
    lines = []
    for name, value in fields:
        if value is not None:
            safe = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)
            lines.append(f"{name}: {safe}\r\n")
    return "".join(lines).encode("utf-8", "surrogatepass")


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    fields = [*fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(fields) + b"\r\n" + block + b"\r\n\r\n"


def _information(name: str, options: ArchiveOptions) -> bytes:
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Filename", name),
        ("WARC-Date", options.date),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record(fields, b"format: WARC File Format 1.1\r\n")


def _page(page_id: int | None) -> str:
    return f"<{PAGE}{'' if page_id is None else page_id}>"


def record_bytes(record: dict, options: ArchiveOptions) -> bytes:
    revisit = record["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(record["digest"])).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _page(record["page_id"])),
        ("WARC-Target-URI", record["url"]),
        ("WARC-Date", options.date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", _page(record["refers_to"]) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['size']}\r\n\r\n"
    return _record(fields, http.encode() + (b"" if revisit else record["payload"]))


def read_archives(manifest: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload)`` of all archives.

    Archives are streamed frame by frame; a frame that is not a whole, valid
    record (lengths, digest, end) raises ``ValueError`` with its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in archive_records(path, chunk):
                    rows.append(row)
                    held += row["payload_bytes"]
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    # Rows that are only paths would be coalesced into one task without a number.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("path").repartitionByRange(max(1, min(manifest.count(), tasks)), "path")
    return spread.mapInArrow(
        run,
        "page_id long, url string, record_type string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary",
    )


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def archive_records(path: str, chunk: int = 1 << 20) -> Iterator[dict]:
    system, name = _file_system(path)
    with system.open_input_stream(name, compression=None) as file:
        for number, data in enumerate(frames(file, chunk)):
            try:
                row = parsed(data)
            except (ValueError, KeyError, IndexError) as problem:
                raise ValueError(f"{path}, frame {number}: {problem!r}") from problem
            if row is not None:
                yield row


def frames(file, chunk: int) -> Iterator[bytes]:
    """The content of each frame, decoded with the dictionary of the leading one."""
    import zstandard

    head = file.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = file.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary is cut off")
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    rest = file.read(chunk)
    while rest:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("a frame is cut off")
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as problem:
                raise ValueError(f"not a frame: {problem}") from problem
            rest = frame.unused_data if frame.eof else file.read(chunk)
        yield b"".join(parts)
        rest = rest or file.read(chunk)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in lines.decode("utf-8", "surrogatepass").split("\r\n") if x)
    return {k.lower(): v for k, v in pairs}


def _page_id(name: str) -> int | None:
    if not name.startswith(f"<{PAGE}") or not name.endswith(">"):
        raise ValueError(f"not a page: {name}")
    return int(name[len(PAGE) + 1 : -1]) if name[len(PAGE) + 1 : -1] else None


def parsed(data: bytes) -> dict | None:
    """The record in a frame, checked; None for records that are not pages."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not found or version != b"WARC/1.1":
        raise ValueError("no WARC header")
    fields = _fields(lines)
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("the length does not hold")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("no HTTP header")
    stated = int(_fields(http.partition(b"\r\n")[2])["content-length"])
    method, _, coded = fields["warc-payload-digest"].partition(":")
    digest = base64.b32decode(coded).hex()
    if method != "sha1" or len(digest) != 40:
        raise ValueError("no SHA-1 digest")
    if kind == "response":
        if len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload differs from its length or digest")
    elif payload or fields["warc-profile"] != REVISIT:
        raise ValueError("not a revisit of an identical payload")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": stated,
        "payload": payload if kind == "response" else None,
    }


def archive_round_trip(pages: DataFrame, folder: str, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """The records of ``pages`` (page_id, url, html), written below ``folder`` and read back.

    Of equal payloads of at least ``least_bytes`` the one with the largest page
    is stored and the others revisit it. Null html is an empty payload, a null
    url is left out. A null page never stands for others; pages that repeat with
    the largest number are all stored. An empty table makes no archive.
    """
    return read_archives(write_archives(with_revisits(pages, options), folder, options))
