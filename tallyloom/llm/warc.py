"""WARC archives: written by Spark, read back, and assembled into captures.

A capture is a transaction of three records, a request, a response (or a
revisit of an earlier payload) and metadata; request and metadata name their
response through WARC-Concurrent-To. ``write_archive`` lays pages out as such
records; ``read_archive`` parses archives, by Content-Length, into a row for
each record; ``assemble`` joins the three kinds through their identifiers
and gives one nested row for each capture.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes, that with
the largest page_id is a response; the others are revisits that carry its
identifier, the payload's digest and the HTTP header (hence the payload's
length), but no payload.

Defined cases: a null page is an empty payload; a null page_id sorts before
all others, and its capture has a null page_id; a null url is written as
``urn:tallyloom:none`` and read back as null; equal rows (page_id, url and
html) are one capture with ``copies``; rows of one page_id with different
urls are different captures, of which one is the response; extra columns are
ignored; an empty table gives an empty archive; archives that are cut off or
broken give the records that can be read, with their ``problem``.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import Scratch, bound_arrow_batches

LEAST_BYTES = 1000
#: Bytes of payload that one archive file holds on average.
FILE_BYTES = 24 << 20

_NO_URL = "urn:tallyloom:none"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, url: Column, digest: Column, kind: str) -> Column:
    """The identifier of a page's record of some kind: the same for equal rows."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit(_NO_URL)), digest).cast("binary"))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, rid: Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record as text, without the two line ends that close it."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {_DATE}\r\nWARC-Record-ID: "), rid]
    for name, value in fields:
        head += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*head, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A row for each page with the texts of its three records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("response_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), "response"))
    # The last of each large payload that occurs more than once; equal rows are one capture.
    chosen = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "response_id")).alias("chosen"), F.min("response_id").alias("least"), F.max("response_id").alias("most"))
    chosen = chosen.filter("least <> most").select(F.col("digest").alias("its_digest"), "chosen")
    rows = rows.join(chosen, rows["digest"] == chosen["its_digest"], "left")
    revisit = F.coalesce(F.col("response_id") != F.col("chosen.response_id"), F.lit(False))
    uri = F.coalesce(F.regexp_replace("url", "[\r\n]", " "), F.lit(_NO_URL))
    target = ("WARC-Target-URI", uri)
    # Digests are written in hexadecimal, so that they need no Python on the way.
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    response = _record("response", F.col("response_id"), [target, digest], "application/http; msgtype=response", F.concat(http, F.col("html")))
    again = _record("revisit", F.col("response_id"), [target, digest, ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", F.col("chosen.response_id"))], "application/http; msgtype=response", http)
    concurrent = ("WARC-Concurrent-To", F.col("response_id"))
    ids = {kind: _record_id(F.col("page_id"), F.col("url"), F.col("digest"), kind) for kind in ("request", "metadata")}
    ask = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", ids["request"], [target, concurrent], "application/http; msgtype=request", ask)
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit("\r\n"))
    metadata = _record("metadata", ids["metadata"], [target, concurrent], "application/warc-fields", about)
    return rows.select(F.when(revisit, again).otherwise(response).alias("main"), request.alias("request"), metadata.alias("metadata"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Archives of all pages as gzip files in ``path``: each record closed by two line ends, as the format asks.

    Records are written where the join with the chosen payloads leaves them,
    so payloads are shuffled once; files are cut after so many records that
    they hold about FILE_BYTES.
    """
    size, rows = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    records = plan_records(pages, least).select(F.explode(F.array("request", "main", "metadata")).alias("value"))
    files = max(1, -(-(size or 0) // FILE_BYTES))
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(3, 3 * rows // files))
    writer.text(path)


def parse(data: bytes):
    """Header fields (lower-case names), block and problem (null, or what is wrong) of each record.

    A record that ends early is given with what is there. Without a usable
    length, or where no record begins, the block goes on to what looks like
    the next record's beginning.
    """
    at, n = 0, len(data)
    while at < n:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= n:
            return
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : stop if stop >= 0 else n].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            following = data.find(b"\r\n\r\nWARC/", at)
            yield {}, data[at : following if following >= 0 else n], "no record"
            at = following if following >= 0 else n
            continue
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        if stop < 0:
            yield fields, b"", "truncated"
            return
        begin = stop + 4
        length = fields.get("content-length", "")
        if not length.isdecimal():
            following = data.find(b"\r\n\r\nWARC/", begin)
            at = following if following >= 0 else n
            yield fields, data[begin:at], "no length"
            continue
        at = begin + int(length)
        yield fields, data[begin:at], "truncated" if at > n else None


def digest_hex(text: str | None) -> str | None:
    """A digest field in lower-case hexadecimal, from that or from base32."""
    if not text:
        return None
    value = text.rpartition(":")[2]
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except binascii.Error:
        return value.lower()


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, block string, problem string"
_FIELDS = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri")


def _unpacked(data: bytes) -> bytes:
    """The bytes of an archive, packed or not; of a packed one that ends early or is broken, what can be read."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.decompress(data)
    except (EOFError, OSError, zlib.error):
        out, rest = [], data
        while rest:
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(rest))
            except zlib.error:
                break
            rest = member.unused_data
        return b"".join(out)


def _records(batches):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for data in batch.column(0).to_pylist():
            raw = _unpacked(data)
            rows, held = [], 0
            for fields, block, problem in parse(raw):
                kind, digest, size = fields.get("warc-type"), digest_hex(fields.get("warc-payload-digest")), None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        size = len(payload)
                        own = hashlib.sha1(payload).hexdigest()
                        if digest and digest != own:
                            problem = problem or "digest"
                        digest, block = own, payload
                    else:
                        said = next((x.split(b":")[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
                        size = int(said) if said.isdigit() else None
                        block = b""
                rows.append((*(fields.get(f) for f in _FIELDS), digest, size, block.decode("utf-8", "replace"), problem))
                held += len(block)
                if held > 4 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in ``path``; payloads' lengths and digests are taken from the payloads.

    ``problem`` says what is wrong with a record: truncated, no length, no
    record (bytes where one should begin) or digest (the payload has another
    one than its header says); null for sound records.
    """
    bound_arrow_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its identifier, url, payload facts, request, metadata and number of copies.

    Records of one identifier are one record. Captures without request or
    metadata keep nulls there; requests and metadata without their response
    are captures of their own, of record_type null.
    """
    main = records.filter(F.col("record_type").isin("response", "revisit")).groupBy("record_id").agg(
        F.min(F.struct("record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")).alias("answer"), F.count("*").alias("copies")
    )
    side = lambda kind: records.filter(F.col("record_type") == kind).groupBy(F.coalesce("concurrent_to", "record_id").alias("record_id")).agg(F.min(F.struct("record_id", "target_uri", "block")).alias(kind))
    joined = main.join(side("request"), "record_id", "full").join(side("metadata"), "record_id", "full")
    return joined.select(
        "record_id",
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.nullif(F.coalesce("answer.target_uri", "request.target_uri", "metadata.target_uri"), F.lit(_NO_URL)).alias("url"),
        F.col("answer.record_type").alias("record_type"),
        F.struct("answer.payload_digest", "answer.payload_bytes", "answer.refers_to").alias("response"),
        "request",
        "metadata",
    )


def page_of(metadata: Column) -> Column:
    return F.regexp_extract(metadata, r"page-id: (-?\d+)", 1).try_cast("long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.new_path("archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # Payloads have served once they are measured; they needn't travel to the join. Archives are parsed once.
    records = scratch.table(read_archive(spark, path).withColumn("block", F.when(F.col("record_type").isin("request", "metadata"), F.col("block"))), "records")
    captures = scratch.table(assemble(records).select("record_id", "copies", "record_type", "response", page_of(F.col("metadata.block")).alias("page_id")), "captures")
    firsts = captures.filter("record_type = 'response'").select(F.col("record_id").alias("first_id"), F.col("page_id").alias("first_page"))
    named = captures.join(firsts, F.col("response.refers_to") == F.col("first_id"), "left")
    return named.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), "record_type", F.col("first_page").alias("refers_to")
    )


def op10_sql() -> str:
    return f"""
    WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    facts AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM payloads),
    last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM facts)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> last_id THEN last_id END AS refers_to FROM last"""
