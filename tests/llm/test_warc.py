import base64
import gzip
import hashlib
import zlib

import pytest

from sparkrecall.llm.warc import WarcError, read_archives, records, round_trip, write_archives, write_record

PAGES = "page_id bigint, url string, html string"


def brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "").encode() == data]
        first = min(same) if same and len(data) >= 100 else i
        revisit = first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big = "<p>é🎉" + "x" * 200
    rows = [(5, "http://a/", big), (2, "http://b/", big), (9, None, big), (None, "u", big), (1, "c\r\nWARC-Type: x", "short"), (3, "d", "short"), (4, "e", None), (6, "f", ""),
            (7, "g", "y" * 2_000_000), (-8, "h", "WARC/1.1\r\n\r\n" * 50), (2, "http://b/", big)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as refers_to")
    got = round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    full = {r["page_id"]: r for r in read_archives(write_archives(df)).collect()}
    assert bytes(full[7]["payload"]).decode() == "y" * 2_000_000 and bytes(full[9]["payload"]) == b""
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_each_record_is_a_member_and_breaks_are_found(spark):
    data = b"payload " * 40
    good = write_record(1, "http://x/", data, hashlib.sha256(data).hexdigest(), None)
    two = good + write_record(2, "http://y/", data, hashlib.sha256(data).hexdigest(), 1)
    assert len(list(records(two))) == 2 and next(records(good))[1] == data and len(list(records(two, 7))) == 2
    with pytest.raises(WarcError):
        list(records(two[:-9]))
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"payload payload", b"payl0ad payload", 1), raw.replace(b"Content-Length: 320", b"Content-Length: 319"), b"x" + raw, raw[:-1], raw + b"x",
                raw.replace(b"WARC-Type: response\r\n", b""), raw.replace(b"Content-Length: 320", b"Content-Length: many"), raw[:40], b""):
        with pytest.raises(WarcError):
            list(records(gzip.compress(bad)))
    broken = spark.createDataFrame([("a", bytearray(two)), ("b", bytearray(good + b"junk"))], "archive string, content binary")
    rows = read_archives(broken, strict=False).collect()
    assert sorted(r["archive"] for r in rows if r["error"]) == ["b"] and len(rows) == 4


def test_files_are_read_alike(spark, tmp_path):
    data = b"z" * 150
    (tmp_path / "one.warc.gz").write_bytes(write_record(1, "u", data, hashlib.sha256(data).hexdigest(), None))
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.gz").withColumnRenamed("path", "archive")
    assert [(r["page_id"], r["payload_bytes"]) for r in read_archives(files).collect()] == [(1, 150)]


def foreign(head, block):
    """A record as a crawler writes it."""
    lines = b"".join(k.encode() + b": " + (v if isinstance(v, bytes) else v.encode()) + b"\r\n" for k, v in head)
    return gzip.compress(b"WARC/1.0\r\n" + lines + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")


def test_archives_of_a_crawler(spark, tmp_path):
    body = "<p>héllo</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    info = foreign([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0f64b2a3-7a3c-4d11-8f50-5d2a6fb0a111>")], b"software: crawler\r\n")
    good = foreign(
        [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:a4b5c6d7-7a3c-4d11-8f50-5d2a6fb0a112>"), ("WARC-Target-URI", b"http://x/\xe9"),
         ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", sha1(http)), ("WARC-Payload-Digest", sha1(body)),
         ("X-Folded", "one\r\n two")], http)
    again = foreign([("WARC-Type", "revisit"), ("WARC-Refers-To", "<urn:uuid:a4b5c6d7-7a3c-4d11-8f50-5d2a6fb0a112>"), ("WARC-Payload-Digest", sha1(body))], b"")
    hexed = foreign([("WARC-Type", "resource"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest()), ("WARC-Block-Digest", "blake9:zz")], body)
    wrong = foreign([("WARC-Type", "response"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", sha1(http))], http)
    (tmp_path / "a.warc.gz").write_bytes(info + good + again + hexed)
    (tmp_path / "b.warc.gz").write_bytes(hexed + wrong)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.gz").withColumnRenamed("path", "archive")
    rows = read_archives(files, strict=False).collect()
    of_a = [r for r in rows if r["archive"].endswith("a.warc.gz")]
    assert [r["record_type"] for r in of_a] == ["warcinfo", "response", "revisit", "resource"] and not any(r["error"] for r in of_a)
    assert bytes(of_a[1]["payload"]) == body and of_a[1]["payload_bytes"] == len(body) and of_a[1]["url"] == "http://x/é"
    assert of_a[2]["refers_to"] is None and of_a[2]["refers_to_uri"] == of_a[1]["record_id"] and of_a[1]["page_id"] is None
    assert [r["error"] for r in rows if r["archive"].endswith("b.warc.gz")] == [None, "payload digest"]


def test_a_member_that_goes_on_is_given_up(spark):
    bomb = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"0" * 200_000_000)
    with pytest.raises(WarcError):
        list(records(bomb))
    rows = read_archives(spark.createDataFrame([("n", None), ("e", bytearray()), ("b", bytearray(bomb))], "archive string, content binary"), strict=False).collect()
    assert [(r["archive"], r["error"]) for r in rows] == [("b", "the record does not end where Content-Length says")]
