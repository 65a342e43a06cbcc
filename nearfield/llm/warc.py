"""WARC archives with dictionary-compressed records, written and read by Spark.

Each file starts with a skippable Zstandard frame that embeds a dictionary built from
the first DICTIONARY_SAMPLE bytes of its records; then every record is a frame of its own,
so one record can be read without the others. Files are committed by Spark's
text sink: its line separator is an empty skippable frame, which readers pass
over, and so any file system that Spark writes to will do and retries are safe.

Of pages with equal payloads the one with the largest id is stored as a response, the
others as revisit records without payload.

Edge cases: a null page has an empty payload; rows without id are left out; rows
that share an id are records of their own; blanks and control characters in a URL are
percent-encoded and decoded again; a null URL has no target; payloads may be long, up to what
a row can hold; without pages no archive is written and reading gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.runtime import prepare

ARCHIVE_BYTES = 64 << 20  # payload of one file, about
LEAST_BYTES = 2 << 20  # smaller files are not made for the sake of more tasks
DICTIONARY_SAMPLE = 2 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
# An empty skippable frame in ASCII, the magic numbers of the dictionary's frame and of a Zstandard frame.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
# Names of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _unquoted(url: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A row of RECORDS. A response's size and digest are those of the payload that was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page_id = int(fields["WARC-Record-ID"].rpartition(":")[2].rstrip(">"))
    url = _unquoted(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    stated = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return page_id, url, "revisit", int(fields["WARC-Refers-To"].rpartition(":")[2].rstrip(">")), size, stated, None
    found = digest(payload)
    if found != stated:
        raise ValueError(f"record {page_id}: the payload's digest is not the stated one")
    return page_id, url, "response", None, len(payload), found, payload


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too uniform samples: their own bytes serve
        joined = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(joined, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(joined) >= 8 else None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the embedded dictionary, then each record."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= DICTIONARY_SAMPLE:
            break
    if not held:
        return
    shared = dictionary(held)
    if shared is not None:
        body = zstandard.compress(shared.as_bytes(), 9)
        yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True).compress
    for r in held:
        yield compress(r)
    held.clear()
    for r in records:
        yield compress(r)


def unframed(archive: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    shared, at, view = None, 0, memoryview(archive)
    window = 1 << 16
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                body = bytes(view[at + 8 : at + 8 + size])
                shared = zstandard.ZstdCompressionDict(zstandard.decompress(body) if body[:4] == FRAME_MAGIC else body)
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        parts = []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(reader.decompress(view[at : at + window]))
            at += min(window, len(view) - at)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def plan(pages: DataFrame, page_id: str, url: str, html: str, least: int, files: int) -> DataFrame:
    """Rows (page_id, url, payload, refers_to), dealt into files by page. Only hashes are grouped: a
    payload is moved once, however many pages share it."""
    rows = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    keys = rows.select("page_id", "key", F.octet_length("payload").alias("size"))
    groups = keys.groupBy("key").agg(F.max("page_id").alias("refers_to"))
    again = keys.join(groups, "key").where((F.col("size") >= least) & (F.col("page_id") != F.col("refers_to"))).select("page_id", "key", "refers_to").distinct()
    dealt = rows.repartition(files, "page_id", "key").join(again.repartition(files, "page_id", "key").hint("merge"), ["page_id", "key"], "left")
    # In a file pages lie in hash order, so its first records, of which its dictionary is made, are spread over all its pages.
    return dealt.select("page_id", "url", "payload", "refers_to").sortWithinPartitions(F.xxhash64("page_id"), "page_id")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Writes the pages as archives into the folder path. Equal payloads of at least `least` bytes are stored once."""
    spark = prepare(pages.sparkSession)
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    files = max(1, -(-total // ARCHIVE_BYTES), min(cores, total // LEAST_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns)))
        held, size = [], 0
        for frame in frames(record(*row) for row in rows):
            held.append(frame)
            size += len(frame)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    plan(pages, page_id, url, html, least, files).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in the folder path, as rows of RECORDS."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in unframed(content.as_buffer()):
                    held.append(parse(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)
