"""WARC archives: a writer of one gzip member per record, and a sequential
reader.

Writer.  Tasks turn rows into records and join the gzip members of up to
``archive_bytes`` to one archive.  Archives are written by Spark's own text
writer, a row per file, so they go to any file system Spark writes to, with
its commit protocol (a lost task leaves nothing behind).  The text writer ends
each row with a line separator; here that is itself a gzip member holding a
fixed warcinfo record, so every archive is a plain sequence of record members.

Reader.  A file is walked member by member with incremental decompression: a
small state machine takes the decompressed bytes as they come, frames the
record's header and its block by Content-Length, and digests block and
payload on the way.  A record that is cut, misframed or fails a digest is
reported with its error, and reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, shared_folder, small_batches, table

ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FEED = 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


#: The member behind every archive's last record.
TRAILER = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{NAME}info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n"))


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit without it.  Both
    carry the HTTP header and digest of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # a header value is one line; what would break it is percent-encoded
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    name = lambda i: f"<{NAME}{'' if i is None else i}>"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    return record(headers, block)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, payload) with revisit and refers_to: of equal
    payloads of at least ``least_bytes`` bytes, the smallest page_id is the
    response and the others revisit it.  Rows that share that smallest id are
    all responses; null ids revisit (they are responses only if no equal
    payload has an id).  Other columns, whatever their names, are not read; an
    empty table gives an empty result."""
    pages = pages.select("page_id", "url", "payload")
    digest = F.sha2("payload", 256)
    narrow = pages.where(F.octet_length("payload") >= least_bytes).select("page_id", digest.alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    again = narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct().select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to")
    # by id and digest: rows of one payload are not dealt to one task
    dealt = pages.withColumn("digest", digest)
    return dealt.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages(page_id, url, payload, refers_to) as archives of at most
    about ``archive_bytes`` (or one record, however long) under ``path``.  An
    empty table writes no record."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

        for b in small_batches(batches, 256):
            for i, url, payload, to in zip(*(c.to_pylist() for c in b.columns)):
                held.append(member(page_record(i, url, payload, to, to is not None)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    archives = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive binary")
    text = archives.select(F.col("archive").cast("string").alias("value"))
    text.write.option("lineSep", TRAILER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


class Framer:
    """Takes one member's bytes as they are decompressed."""

    def __init__(self):
        self.head, self.headers, self.left, self.tail = b"", None, 0, b""
        self.http, self.payload = b"", []
        self.block_sha, self.payload_sha, self.in_payload = hashlib.sha1(), hashlib.sha1(), False

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            stop = self.head.find(b"\r\n\r\n")
            if stop < 0:
                return
            lines = self.head[:stop].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left = int(self.headers["content-length"])
            data = self.head[stop + 4:]
        block, rest = data[: self.left], data[self.left:]
        self.left -= len(block)
        self.tail += rest
        if len(self.tail) > 4:
            raise ValueError("bytes behind the record")
        self.block_sha.update(block)
        if self.headers.get("content-type", "").startswith("application/http") and not self.in_payload:
            self.http += block
            stop = self.http.find(b"\r\n\r\n")
            if stop < 0:
                return
            block, self.http, self.in_payload = self.http[stop + 4:], self.http[:stop], True
        if self.in_payload:
            self.payload.append(block)
            self.payload_sha.update(block)

    def close(self) -> dict:
        if self.headers is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("cut record")
        h, kind = self.headers, self.headers.get("warc-type")
        digests = [("warc-block-digest", self.block_sha)] + [("warc-payload-digest", self.payload_sha)] * (kind == "response")
        for name, sha in digests:
            if name in h and h[name] != "sha1:" + base64.b32encode(sha.digest()).decode():
                raise ValueError(f"{name} differs")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in self.http.decode("latin-1").split("\r\n")[1:])}
        return {"record_type": kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
                "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(http["content-length"]) if "content-length" in http else None,
                "payload": b"".join(self.payload) if kind == "response" else None, "error": None}


def read_members(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, frame, error, begin = zlib.decompressobj(31), Framer(), None, at
        try:
            while not z.eof and at < len(data):
                piece = view[at: at + FEED]
                at += len(piece)
                frame.feed(z.decompress(piece))
            if not z.eof:
                raise ValueError("cut member")
            at -= len(z.unused_data)
            yield frame.close()
        except (ValueError, KeyError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
        if error:
            # the next member's mark behind this one's start; a mark inside
            # compressed bytes fails at once and the search goes on
            at = begin + 1
            found = data.find(b"\x1f\x8b\x08", at)
            at = len(data) if found < 0 else found
            yield dict.fromkeys(FIELDS) | {"error": error}


FIELDS = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "error"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under ``path``: archive, record_type, record_id,
    target_uri, refers_to, payload_digest (bare base32), payload_bytes (of the
    full payload), payload (responses only) and error (null if sound).  A file
    is one binary row, decompressed record by record: archives should be of
    some hundred MB at most (Spark reads none above 2 GB).  A folder without
    archives gives an empty result."""
    prepare(spark)
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                name, rows = b.column(0)[r].as_py(), []

                def out():
                    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([x[f] for x in rows], k) for f, k in zip(FIELDS, kinds))], ["archive", *FIELDS])

                for x in read_members(b.column(1)[r].as_py()):
                    rows.append(x)
                    if len(rows) >= 512:
                        yield out()
                        rows = []
                yield out()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; edge cases as in
    ``with_revisits``, ``write_archives`` and ``read_archives``."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    path = shared_folder(spark, "warc")
    write_archives(with_revisits(pages), path)
    number = lambda c: F.regexp_extract(c, f"^<{NAME}(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    out = read_archives(spark, path).where("record_type is null or record_type <> 'warcinfo'")
    return out.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), "error")


_BIT = " + ".join(f"{1 << (4 - k)} * (substr(bits, (5 * i + {k + 1})::bigint, 1) = '1')::int" for k in range(5))
OP4_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, cast(unhex(sha1(html)) as bit)::varchar as bits, min(page_id) over (partition by html) as low from p)
select page_id, octet_length(encode(html)) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + {_BIT})::bigint, 1)), '') as payload_digest,
       case when page_id = low then 'response' else 'revisit' end as record_type,
       case when page_id = low then null else low end as refers_to,
       cast(null as varchar) as error
from d
"""
