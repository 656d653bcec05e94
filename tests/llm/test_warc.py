"""WARC archives: exact round trip."""

import hashlib

from tallyloom.llm import warc
from tallyloom.session import Scratch


def test_round_trip(spark):
    big, small = "<p>été\r\n\r\nWARC/1.1</p>" * 80, "tiny"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, "http://c/", small), (4, "http://d/", small), (5, None, None), (6, "http://e/", ""), (None, "http://n/", big), (2, "http://b/", big), (7, "x\r\ny", "z" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = Scratch(spark, "t").new_path("warc")
    warc.write_archive(pages, path)
    captures = warc.assemble(warc.read_archive(spark, path)).collect()
    assert sum(c["copies"] for c in captures) == len(rows)
    by = {}
    for c in captures:
        by[c["url"]] = c
        assert c["request"]["block"].startswith("GET ") and "page-id: " in c["metadata"]["block"]
    assert by["http://b/"]["record_type"] == "response" and by["http://b/"]["copies"] == 2
    assert by["http://a/"]["record_type"] == by["http://n/"]["record_type"] == "revisit"
    assert by["http://a/"]["response"]["refers_to"] == by["http://b/"]["record_id"]
    for url, text in (("http://a/", big), ("http://c/", small), ("http://e/", ""), ("x  y", "z" * 2_000_000)):
        r = by[url]["response"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
    assert by["http://c/"]["record_type"] == by["http://d/"]["record_type"] == "response"
    assert by[None]["response"]["payload_bytes"] == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(1, "u", "line\n\r\n\r\nend"), (2, "v", "")], "page_id long, url string, html string")
    path = Scratch(spark, "t").new_path("warc")
    warc.write_archive(pages, path)
    got = {r["target_uri"]: r["block"] for r in warc.read_archive(spark, path).filter("record_type = 'response'").collect()}
    assert got == {"u": "line\n\r\n\r\nend", "v": ""}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = Scratch(spark, "t").new_path("warc")
    warc.write_archive(pages, path)
    assert warc.assemble(warc.read_archive(spark, path)).count() == 0


def test_digests_in_base32():
    assert warc.digest_hex("sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5") == hashlib.sha1(b"abc").hexdigest()


def test_broken_archives(spark):
    import gzip

    record = lambda kind, body, extra=b"": b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + kind + b">\r\n" + extra + b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    good = record(b"response", http)
    wrong = record(b"response", http, b"WARC-Payload-Digest: sha1:00\r\n")
    nameless = b"WARC/1.1\r\nWARC-Type: metadata\r\n\r\nno length here\r\n\r\n"
    rows = [(1, good + b"rubbish\r\n\r\n" + nameless + wrong + good[:-9]), (2, gzip.compress(good) + gzip.compress(good * 50)[:-20]), (3, b""), (4, b"WARC/1.1\r\nWARC-Type: request")]
    got = {}
    for k, data in rows:
        batch = next(iter(spark.createDataFrame([(bytearray(data),)], "content binary").mapInArrow(warc._records, warc.RECORD).groupBy().pivot("problem").count().collect()), None)
        got[k] = {n: v for n, v in (batch.asDict() if batch else {}).items() if v}
    assert got[1] == {"null": 1, "no record": 1, "no length": 1, "digest": 1, "truncated": 1}
    assert got[2]["null"] >= 1 and got[3] == {} and got[4] == {"truncated": 1}


def test_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>", "x", "y", "z")], "page_id long, url string, html string, digest string, record_id string, block string")
    path = Scratch(spark, "t").new_path("warc")
    warc.write_archive(pages, path)
    assert [c["response"]["payload_bytes"] for c in warc.assemble(warc.read_archive(spark, path)).collect()] == [3]
