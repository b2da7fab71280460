"""WARC archives of pages: a writer with revisit records and a splittable reader.

Writing: every page is a record, gzipped as a member of its own, and Spark's text writer commits the
files: a member of less than 16 MiB ends in a zero byte (the top byte of its length), which is the line
separator here; after a longer one comes an empty member, which ends in a zero byte too. Of records with
equal payloads of at least ``least`` bytes the one with the largest page id is a response and the others
refer to it; shorter payloads are stored each time.

Reading: files are cut into byte ranges whatever lies at their edges. A task searches its range for gzip's
magic bytes, takes a candidate for a member if it inflates to a WARC version line and its checksum holds,
and owns the records that start inside its range, reading on past the end for the last one. Archives are
opened by URI through pyarrow's file systems, so tasks on any machine read them from shared storage.

Defined results: a null html is an empty payload; a null url gives no target; null page ids stay null and
never are the referred record, and where all ids of a group are null all are responses; rows that repeat
the largest id of a group are all responses; an empty table gives an archive without records; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capforge.llm.common import join_per_key, task_memory, text_or_empty

LEAST = 1000
RANGE = 16 << 20
LEVEL = 6

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMED = "urn:x-page:"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{NAMED}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base32(digest)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{NAMED}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member (and an empty one after 16 MiB or more) without its last byte, which is zero."""
    out = gzip.compress(data, LEVEL, mtime=0)
    return (out if len(data) < 1 << 24 else out + gzip.compress(b"", LEVEL, mtime=0))[:-1]


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               least: int = LEAST) -> None:
    task_memory(pages.sparkSession)
    body = text_or_empty(F.col(html))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    first = rows.filter(F.col("n") >= least).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first")
    linked = join_per_key(rows, first, "digest").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = [member(record(p, u, h.encode(), d, r)) for p, u, h, d, r in zip(*(part.column(k).to_pylist() for k in range(5)))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    linked.mapInArrow(build, "member binary").select(F.col("member").cast("string").alias("value")).write.option(
        "lineSep", "\0").text(path)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflate(read, buffer: bytearray, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` of ``buffer`` and its length; None if it isn't a WARC record. ``read()`` gives
    more bytes to add to the buffer, or none at the end of the file."""
    out, used, step = [], 0, 4096
    inflater = zlib.decompressobj(31)
    seen = b""
    while not inflater.eof:
        if at + used >= len(buffer):
            more = read()
            if not more:
                return None
            buffer += more
        piece = bytes(buffer[at + used:at + used + step])
        try:
            out.append(inflater.decompress(piece))
        except zlib.error:
            return None
        used += len(piece) - len(inflater.unused_data)
        step = min(step * 2, 1 << 20)
        if len(seen) < 5:
            seen = (seen + out[-1])[:5]
            if seen != b"WARC/"[:len(seen)]:
                return None
    return (b"".join(out), used) if seen == b"WARC/" else None


def records(file, start: int, stop: int) -> Iterator[bytes]:
    """The records that start in bytes [start, stop) of an open file."""
    file.seek(start)
    buffer, size = bytearray(file.read(stop - start + len(MAGIC) - 1)), stop - start
    at = buffer.find(MAGIC)
    while 0 <= at < size:
        found = inflate(lambda: file.read(1 << 18), buffer, at)
        if found:
            yield found[0]
        at = buffer.find(MAGIC, at + (found[1] if found else 1))


def parsed(data: bytes) -> tuple:
    """(page_id, url, date, record_type, payload, payload_bytes, payload_digest, refers_to)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(NAMED + r"(-?\d+)>", warc.get(name, ""))) else None
    kind = warc["warc-type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if warc["warc-payload-digest"] != "sha1:" + base32(digest):
            raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
    else:
        payload, size = None, int(fields(http)["content-length"])
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    return number("warc-record-id"), warc.get("warc-target-uri"), warc["warc-date"], kind, payload, size, digest, number("warc-refers-to")


FIELDS = ("page_id long, url string, date string, record_type string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to long")


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE, payload: bool = True) -> DataFrame:
    """One row per record of the archives in the folder ``path``; without ``payload`` that column is null."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").cast("long").alias("length"))
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()), "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()),
                            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for uri, length, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with system.open_input_file(name) as file:
                    rows = []
                    for data in records(file, start, min(length, start + range_bytes)):
                        row = parsed(data)
                        rows.append(row if payload else (*row[:4], None, *row[5:]))
                        if len(rows) >= (64 if payload else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return ranges.mapInArrow(scan, FIELDS)
