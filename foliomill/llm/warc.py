"""WARC archives with revisit records for repeated payloads.

Only headers (digest, id) are grouped to find each payload's original; the records
then meet their original by digest in a join whose skew can be split. A task
writes its records as gzip members of an archive in the shared folder, with fresh
headers; a revisit record holds no payload but names its original.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import load_file, new_folder, save_file, slices
from foliomill.session import written

MIN_PAYLOAD = 1000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"  # pages carry no capture time


def resolved(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages (page_id, url, payload) with payload_bytes, payload_digest, record_type and refers_to.

    Among equal payloads of at least ``min_payload`` bytes the largest page_id is the
    response and the others revisit it; shorter ones are all responses. Null html is an
    empty payload. Rows repeated with the response's id are responses too, and a null
    page_id is never an original unless all are null; then all are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )
    long = F.col("payload_bytes") >= min_payload
    originals = (
        rows.filter(long)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("payload_digest").alias("digest"), "original", "original_url")
    )
    joined = rows.join(originals, F.col("payload_digest") == F.col("digest"), "left")
    revisit = long & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
        F.when(revisit, F.col("original_url")).alias("refers_to_url"),
    )


def _header_value(text: str) -> bytes:
    """One line, whatever the value holds."""
    return " ".join(text.split()).encode()


def record(row: dict) -> bytes:
    kind, digest = row["record_type"].encode(), bytes.fromhex(row["payload_digest"])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (row["payload"].encode() if kind == b"response" else b"")
    page_id = row["page_id"]
    lines = [
        VERSION,
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + _header_value(row["url"] or ""),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest),
    ]
    if kind == b"revisit":
        lines += [
            b"WARC-Profile: " + REVISIT_PROFILE,
            b"WARC-Refers-To: <urn:page:%d>" % row["refers_to"],
            b"WARC-Refers-To-Target-URI: " + _header_value(row["refers_to_url"] or ""),
        ]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, unpacked one at a time."""
    start = 0
    while start < len(content):
        member, out, at = zlib.decompressobj(31), [], start
        while not member.eof:
            if at >= len(content):
                raise ValueError("the archive is cut off")
            out.append(member.decompress(content[at : at + step]))
            at += step
        start = min(at, len(content)) - len(member.unused_data)
        yield b"".join(out)


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of an archive: headers, and the payload of those that hold one."""
    for data in members(content):
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].split(b"\r\n")
            if version != VERSION:
                raise ValueError("not a record")
            headers = dict(line.split(b": ", 1) for line in lines)
            block = data[end + 4 : end + 4 + int(headers[b"Content-Length"])]
            http, _, payload = block.partition(b"\r\n\r\n")
            full = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
            yield {"headers": headers, "payload": payload, "full_bytes": full}
            at = end + 4 + len(block) + 4


def write_archives(rows: DataFrame, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write resolved pages to archives of about ``archive_bytes``; a row per archive."""
    folder = new_folder(rows.sparkSession, "warc")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                for row in part.to_pylist():
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    held.append(packer.compress(record(row)) + packer.flush())
                    size, n = size + len(held[-1]), n + 1
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_pydict({"path": [save_file(folder, "pages", ".warc.gz", b"".join(held))], "n": [n]})
                        held, size, n = [], 0, 0
        if held:
            yield pa.RecordBatch.from_pydict({"path": [save_file(folder, "pages", ".warc.gz", b"".join(held))], "n": [n]})

    return written(rows.mapInArrow(save, "path string, n long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives, from its own headers."""

    def number(value: bytes) -> int | None:
        text = value.removeprefix(b"<urn:page:").removesuffix(b">")
        return None if text == b"none" else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                out: list[tuple] = []
                for found in parse_records(load_file(path)):
                    h = found["headers"]
                    refers = h.get(b"WARC-Refers-To")
                    digest = base64.b32decode(h[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
                    out.append(
                        (number(h[b"WARC-Record-ID"]), found["full_bytes"], digest, h[b"WARC-Type"].decode(), number(refers) if refers else None)
                    )
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    spread = archives.repartition(max(1, min(archives.count(), 10_000)), "path")
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), judged AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original
  FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM judged
"""
