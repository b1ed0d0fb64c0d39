"""WARC archives: one gzip member per record, written and read back by many tasks.

Writing: each task writes archives of bounded size to the shared folder; names are new for each attempt, and
only archives that a finished task reports are read, so a lost or repeated task leaves no records behind.
Reading: sequential; 256 KB at a time go through an incremental zlib decompressor, a record ends where its
gzip member ends, Content-Length frames its block, and block and payload digests are verified.

Payload: the html in UTF-8, null as empty. Of rows with equal payloads of at least `least` bytes the one with
the smallest page_id is the response, the others revisit it; a null page_id is not smaller than any other, and rows of
null ids alone are all responses. Rows that repeat a page_id with an equal payload are all the response. Very long payloads
are written whole, one record at a time. Other columns don't matter, whatever their names. A null or empty url gives no target
URI; white space and control characters in a url are percent-encoded. Empty table: no archives, empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import staging, workers

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 18
_SALT = 32
_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


class WarcError(ValueError):
    """An archive that is cut short, misframed or has a wrong digest."""


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:lexmill:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "").rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the response's HTTP header, with its Content-Length, and no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", _DATE)]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", _PROFILE)]
    fields += [("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("WARC-Payload-Digest", f"sha1:{_digest(payload)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream: io.RawIOBase) -> Iterator[bytes]:
    """The content of each gzip member; holds one member and one chunk at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(_CHUNK)):
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            if not data and not (data := stream.read(_CHUNK)):
                return
    if parts:
        raise WarcError("the archive ends inside a record")


def parse(member: bytes) -> dict:
    """Fields of _ROW; raises WarcError where framing or a digest is wrong."""
    head, found, rest = bytes(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} doesn't frame the block")
    block = rest[:n]
    if fields.get("warc-block-digest", f"sha1:{_digest(block)}") != f"sha1:{_digest(block)}":
        raise WarcError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    said, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (_digest(payload) != said or len(payload) != int(inner["content-length"])):
        raise WarcError("wrong payload digest or length")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(inner["content-length"]), "payload_digest": said,
        "record_type": "revisit" if revisit else "response", "refers_to": _page(fields.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, *, least: int = 0, archive_mb: int = 16) -> DataFrame:
    """Writes archives under folder and returns the manifest: path, records, bytes. Only ids and digests are
    grouped, hot payloads pre-aggregated in each task; pages then meet their verdict by page_id, not by payload."""
    workers.ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", F.octet_length(html).alias("n"), F.sha1(html).alias("digest")).filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    ids = staging.stage(known.select("page_id", "digest"), "payload-digests")
    least_ids = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = least_ids.filter("refers_to < last").drop("last")
    verdicts = ids.join(first, "digest").filter("page_id > refers_to").groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to"))
    whole = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    rows = whole.filter("page_id IS NOT NULL").join(verdicts, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    # Pages without an id have but their digest to be found by; a digest that many of them share is dealt out by salt.
    salted = whole.filter("page_id IS NULL").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALT)).cast("int"))
    there = least_ids.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"))
    asked = staging.stage(salted.filter(F.octet_length("html") >= least).select("digest").distinct().join(there, "digest"), "verdicts-without-id")
    rows = rows.unionByName(salted.join(asked, ["digest", "salt"], "left").select("page_id", "url", "html", "refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        store, at = _open(path)
                        store.create_dir(at.rpartition("/")[0], recursive=True)
                        out, n, size = store.open_output_stream(at, compression=None), 0, 0
                    data = record(*row)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_mb << 20:
                        out.close()
                        out = None
                        done.append((path, n, size))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return staging.stage(rows.mapInArrow(archives, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Records of the archives in column path, one archive after another in each task."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for member in members(stream):
                        rows.append(parse(member))
                        size += len(member)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)

    workers.ship(manifest.sparkSession)
    spread = manifest.repartition(max(1, min(10_000, manifest.count())))
    return spread.select("path").mapInArrow(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), staging.new_path(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM m)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * (32 >> j))) AS INTEGER), 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
