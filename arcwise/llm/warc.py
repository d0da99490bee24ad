"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing: each page becomes a response record whose block is an HTTP response with chunked transfer
framing. Of equal payloads of at least ``revisit_bytes`` bytes the one with the smallest page id is
a response, the others are revisit records without payload that name it. A block over
``segment_bytes`` is split into one record with segment number 1 and continuation records. Archives
are written by Spark's text writer into a folder that the whole cluster sees: a record is one
line, and the line separator is the CRLF CRLF that ends a WARC record, so files are plain gzipped
WARC on any file system that Spark writes to.

Reading: files are split into records by their lengths; continuation records are grouped by
origin identifier, ordered by segment number, checked against the total length, and joined; the
chunked framing is decoded. Only records that were segmented are shuffled, compressed.

Null html is an empty payload. Payloads under ``revisit_bytes`` are always responses. Very long
pages are segmented. Null page ids are archived too, as id ``null``, which counts after all others.
Every row has its record, with an identifier of its own: rows that repeat a page id with another html are told apart by
digest, rows that repeat both are all of one type and come back as often as they were given. Empty tables give
empty archives. Extra columns are ignored.
A record whose segments are missing or don't add up raises ValueError with its identifier.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwise.llm.shared import few_files, in_batches, prepared, shared_dir
from arcwise.plans.session import gone_at_exit

REVISIT_BYTES = 100
SEGMENT_BYTES = 32_768
_FRAME = 8_192
#: Rows of an archive: with pages of 4 KB on average, about 8 MB before compression.
ARCHIVE_ROWS = 2_000
_END = b"\r\n\r\n"


def chunked(payload: bytes, frame: int = _FRAME) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for i in range(0, len(payload), frame) if (x := payload[i : i + frame])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the CRLF CRLF that follows it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def records_of(page: str, url: str | None, kind: str, refers: str | None, digest: str, payload: bytes, segment_bytes: int, row: str = "") -> list[bytes]:
    """The record of a page, or its segments. row: tells rows apart that repeat page and payload."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}:{row}')}>"
    target = "".join(url.split()) if url else "about:blank"
    head = [("WARC-Record-ID", own), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers)]
        return [record([*more, *head], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response"), *head]
    if len(block) <= segment_bytes:
        return [record(head, block)]
    cuts = range(0, len(block), segment_bytes)
    out = [record([*head, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for n, at in enumerate(cuts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if at == cuts[-1] else []
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{n}')}>"
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *total], block[at : at + segment_bytes]))
    return out


def read_records(stream):
    """(fields, block) of each record; fields have lower-case names."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("archive is cut short")
        yield fields, block


def _body(block: bytes) -> bytes:
    """Payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the pages' archives under path."""
    prepared(pages.sparkSession)
    base = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    named = base.withColumn("digest", F.sha2("html", 256))
    sized = named.filter(F.octet_length("html") >= revisit_bytes).groupBy("digest", "page").agg(F.count("*").alias("n"))
    firsts = sized.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Only revisits are joined, by page id: a payload's copies are spread over all tasks.
    later = sized.join(firsts.select("digest", "first"), "digest").filter("not (page <=> first)").select(F.col("digest").alias("d"), F.col("page").alias("p"), F.coalesce(F.col("first").cast("string"), F.lit("null")).alias("first"))
    rows = named.join(later, F.col("page").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select(F.coalesce(F.col("page").cast("string"), F.lit("null")).alias("page"), "url", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"), "first", "digest", F.col("html").cast("binary").alias("html"))

    def work(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = batch.slice(a, 64).to_pylist()
                out = [x for i, r in enumerate(rows, n) for x in records_of(r["page"], r["url"], r["kind"], r["first"], r["digest"], r["html"], segment_bytes, f"{task}:{i}")]
                n += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    out = few_files(rows, base).transform(in_batches, work, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Rows (record_id, page, record_type, refers_to, payload_bytes, payload_digest, payload) of the archives under path; a revisit has no payload."""
    prepared(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    said = [("record_id", pa.string()), ("page", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    part = [*said[:-1], ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
    names = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    schema = lambda fields: ", ".join(f"{n} {names[t]}" for n, t in fields)

    def batch_of(rows, fields):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def header(f):
        size = f.get("x-payload-length")
        return (f.get("warc-segment-origin-id", f["warc-record-id"]), f.get("x-page-id"), f["warc-type"], f.get("x-refers-to-page-id"), int(size) if size else None, (f.get("warc-payload-digest") or "").removeprefix("sha256:"))

    def checked(head, block):
        payload = _body(block)
        if len(payload) != head[4] or hashlib.sha256(payload).hexdigest() != head[5]:
            raise ValueError(f"payload of {head[0]} differs from its digest or length")
        return payload

    def parsed(segments):
        """Whole records with their payload, or segments, whose block is compressed for the shuffle."""

        def run(batches):
            for batch in batches:
                for content in batch.column(0):
                    rows, held = [], 0
                    for f, block in read_records(gzip.open(pa.BufferReader(content.as_buffer()))):
                        number, head = f.get("warc-segment-number"), header(f)
                        if bool(number) != segments:
                            continue
                        if segments:
                            total = f.get("warc-segment-total-length")
                            rows.append((*head, int(number), int(total) if total else None, zlib.compress(block, 1)))
                        else:
                            rows.append((*head, None if head[2] == "revisit" else checked(head, block)))
                        held += len(block)
                        if held > 1_000_000:
                            yield batch_of(rows, part if segments else said)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows, part if segments else said)

        return run

    def joined(batches):
        for batch in batches:
            for r in batch.to_pylist():
                parts = sorted((p["number"], p["block"]) for p in r["parts"])
                block = b"".join(zlib.decompress(b) for _, b in parts)
                if [n for n, _ in parts] != [*range(1, len(parts) + 1)] or len(block) != r["total"]:
                    raise ValueError(f"segments of {r['record_id']} are missing or of the wrong length")
                head = (r["record_id"], r["page"], "response", None, r["payload_bytes"], r["payload_digest"])
                yield batch_of([(*head, checked(head, block))], said)

    whole = files.transform(in_batches, parsed(False), schema(said))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    parts = files.transform(in_batches, parsed(True), schema(part)).groupBy("record_id").agg(F.max("total").alias("total"), first("page"), first("payload_bytes"), first("payload_digest"), F.collect_list(F.struct("number", "block")).alias("parts"))
    return whole.unionByName(parts.transform(in_batches, joined, schema(said)))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives into the shared folder and returns what reading them gives, without the payloads."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/arcwise-warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    gone_at_exit(spark, path)
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("bigint"))
    return read_archives(spark, path).select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
