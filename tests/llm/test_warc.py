"""WARC archives: round trip, framing, digests, broken members."""

from __future__ import annotations

import base64
import gzip
import hashlib

from oracle import compare, duck
from pyspark.sql import functions as F

from recensio.llm import warc as W


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def round_trip(spark, rows, tmp_path, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    path = str(tmp_path / "w")
    W.write_archives(W.with_revisits(df), path, **kw)
    return path, W.read_archives(spark, path).where("record_type <> 'warcinfo' or record_type is null").collect()


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ b\r\nX: y", b"<p>same</p>"), (1, None, b"<p>same</p>"), (2, "", b""), (4, "u", b""), (5, "v", bytes(range(256)) * 3000), (-6, "w", b"HTTP/1.1 \r\n\r\nWARC/1.1\r\n\r\n"),
            (7, "r", b"twice"), (7, "r", b"twice"), (None, "n", b"<p>same</p>"), (None, "n", b"alone"), (8, "x", "é\x00\x1f\x8b\x08".encode())]
    _, got = round_trip(spark, rows, tmp_path, archive_bytes=400)
    assert not [r for r in got if r.error]
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    low = {b"<p>same</p>": 1, b"": 2}
    want = []
    for i, _, p in rows:
        to = low.get(p) if low.get(p) != i else None
        want.append((name(i), len(p), sha(p), "revisit" if to is not None else "response", name(to) if to is not None else None, None if to is not None else p))
    assert sorted(want, key=repr) == sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr)


def test_archives_are_plain_gzip(spark, tmp_path):
    path, got = round_trip(spark, [(i, "u", b"x%d" % i * 50) for i in range(40)], tmp_path, archive_bytes=2000)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 2 and len(got) == 40
    for f in files:
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", b"ab"), (2, "u", b"ab"), (3, "u", b"abcdef"), (4, "u", b"abcdef")], "page_id long, url string, payload binary")
    df = df.withColumns({"digest": F.lit("x"), "id": F.lit(0), "d": F.lit(1), "refers_to": F.lit(9)})  # names of its own columns
    got = {r.page_id: r.refers_to for r in W.with_revisits(df, 5).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_broken_members():
    good = [W.member(W.page_record(i, "u", b"body %d" % i, None, False)) for i in range(4)]
    record = W.page_record(9, "u", b"body", None, False)
    broken = [W.member(record.replace(b"body", b"bodi")), W.member(record[:-3]), W.member(record + b"x"), W.member(b"junk"), good[0][:-9]]
    data = b"".join(x for pair in zip(good, broken) for x in pair) + broken[4] + good[3]
    got = list(W.read_members(data))
    assert [r["record_id"] for r in got if not r["error"]] == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 3)]
    assert sum(bool(r["error"]) for r in got) >= 5
    assert list(W.read_members(b"")) == [] and list(W.read_members(good[0][:20]))[0]["error"]


def test_long_record_is_fed_in_pieces():
    body = hashlib.sha512(b"x").digest() * 40_000
    (got,) = W.read_members(W.member(W.page_record(1, "u", body, None, False)))
    assert got["payload"] == body and got["error"] is None


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, payload binary")
    W.write_archives(W.with_revisits(df), str(tmp_path / "e"))
    assert W.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_driver_pages(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        ok, why = compare(W.op4_warc(spark, d), duck(d), W.OP4_SQL)
        assert ok, why
