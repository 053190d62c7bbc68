"""WARC archives with an index written first and read by coalesced byte ranges (operator 3)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Payloads of at least this many bytes are written once; later copies revisit the first.
LEAST_BYTES = 0
#: Date of all records: the archive of a table has no time of its own.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that a task reads; ranges closer than the gap are read as one, up to the length.
CHUNK, GAP, READ = 64 << 20, 64 << 10, 8 << 20
#: Payload bytes of a batch of parsed records.
BATCH = 16 << 20

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def filesystem(uri: str):
    """The Arrow file system of a place and the path in it; a place without scheme is a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one response or revisit record; a revisit holds the HTTP header only."""
    target = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple:
    """The fields of ``RECORD`` from a gzip member; digest and size of a response are taken from its payload."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page_id = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    if fields["WARC-Type"] == "revisit":
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        return page_id, fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(fields["X-Refers-To-Page-ID"]), None
    return page_id, fields["WARC-Target-URI"], len(payload), base32_sha1(payload), "response", None, payload


def write_warc(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in the shared folder; returns their index.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``least_bytes`` bytes the one with the
    smallest page_id is a response and the others revisit it; a null page_id is larger than all. Rows that repeat the
    smallest page_id are responses too. First pages are found by partial aggregation over digests, so a payload that
    fills a third of the table meets in no task. Each task writes an archive of its own, whose name is in the index only
    once the task has ended; what a lost task wrote is never read. An empty table makes no archive. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    named = rows.select("page_id", "sha1", F.octet_length("html").alias("n"))
    heads = named.where(F.col("n") >= least_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1 and head is not null")
    repeats = named.join(heads.drop("copies"), ["sha1", "n"]).where(~F.col("page_id").eqNullSafe(F.col("head"))).select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), F.col("head").alias("refers_to")).distinct()
    marked = rows.join(repeats, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, out, at = None, None, 0
        store, base = filesystem(folder)
        for batch in batches:
            index = []
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    target = f"{folder}/{name}"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                digest = base32_sha1(payload)
                member = make_record(page_id, url, payload, digest, refers_to, refers_to is not None)
                out.write(member)
                index.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, target, at, len(member)))
                at += len(member)
            if index:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], ["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(marked.mapInArrow(write, INDEX), "warc-index")


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the selected rows of an index, parsed; without ``payload`` that column is null.

    Rows of one archive and one stretch of ``CHUNK`` bytes go to a task together, in order of offset; neighbouring ranges
    are coalesced into one read of at most ``READ`` bytes, and parsed records leave the task in batches of about ``BATCH``
    payload bytes, however far they expand. A row that is selected twice is read once. An empty selection gives no rows.
    """
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Archive and neighbouring (offset, length) of each read."""
        at, run = None, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if run and file == at and offset == run[-1][0]:
                    continue
                if run and (file != at or offset - sum(run[-1]) > GAP or offset + length - run[0][0] > READ):
                    yield at, run
                    run = []
                at = file
                run.append((offset, length))
        if run:
            yield at, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, open_name, archive = [], 0, None, None
        for file, run in runs(batches):
            if file != open_name:
                if archive is not None:
                    archive.close()
                store, path = filesystem(file)
                open_name, archive = file, store.open_input_file(path)
            first = run[0][0]
            data = archive.read_at(sum(run[-1]) - first, first)
            for offset, length in run:
                record = parse_record(data[offset - first : offset - first + length])
                found.append(record if payload else (*record[:-1], None))
                size += len(record[-1] or b"") if payload else 64
                if size >= BATCH:
                    yield as_batch(found)
                    found, size = [], 0
        if archive is not None:
            archive.close()
        if found:
            yield as_batch(found)

    chunk = F.floor(F.col("offset") / CHUNK)
    return selected.select("file", "offset", "length").repartition("file", chunk).sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, CAST(unhex(sha1(payload)) AS BIT)::VARCHAR AS bits FROM p),
h AS (SELECT bits, payload_bytes, min(page_id) AS head FROM d GROUP BY ALL)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM d JOIN h USING (bits, payload_bytes)
"""
