"""WARC archives as seekable zstandard bundles.

Every page becomes one record. Of pages with equal payloads the one with the
largest page_id is a response, the others are revisits of it that carry only
the HTTP head. Each task writes one bundle: records grouped into independent
frames, an index from page to frame and offset within it, and a footer with the
seek table. A bundle's name is new for each attempt and reaches readers only
through the written manifest, so a repeated or lost task leaves at most an
unread file.

A null html is an empty payload; a null url leaves out the target header; a
null page_id gives a record without a number, never a leader of others. Rows
that tie on payload and page_id are all responses if they hold the largest id.
An empty table gives no bundle. Extra columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, new_folder, parts_for, written
from .seekable import SeekableReader, write_items

MIN_REVISIT_BYTES = 0
FRAME_BYTES = 256 << 10
CAPTURE_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long"


def _clean(url: str) -> str:
    """A header value: controls would end the header, so they are percent-encoded."""
    return "".join(c if ord(c) > 0x20 and ord(c) != 0x7F else f"%{ord(c):02X}" for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {CAPTURE_DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record; the payload of a revisit is None. A response's digest is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload doesn't match its digest")
    number = lambda name: int(x) if (x := fields.get(name, "")[len(_URN) + 1 : -1]) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload,
        "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
    }


def write_bundles(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive ``pages(page_id, url, html)``; returns the manifest, a row for each bundle written.

    Only digests are aggregated; groups of one aren't kept. The pages are then
    dealt by digest to join the groups' leaders, both sides plain exchanges, so
    a digest that a third of the pages share is split between tasks.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha1("payload"))
    leaders = (
        rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND leader IS NOT NULL")
    )
    leaders = written(leaders.select(F.col("digest").alias("of"), "leader"), "warc-leaders")
    joined = rows.join(leaders, rows["digest"] == leaders["of"], "left").select("page_id", "url", "payload", "leader")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        seen = iter(batches)

        def items():
            for batch in seen:
                for page_id, url, payload, leader in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    revisit = leader is not None and leader != page_id
                    yield page_id, record_bytes(page_id, url, payload, leader, revisit)

        first = next(source := items(), None)
        if first is None:
            return

        def again():
            yield first
            yield from source

        count, size = write_items(name, again(), FRAME_BYTES)
        yield pa.RecordBatch.from_pydict({"bundle": [name], "records": [count], "bytes": [size]})

    return written(joined.mapInArrow(write, "bundle string, records long, bytes long"), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """A row for each record of the bundles in ``manifest``, read from the archives alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with SeekableReader(bundle) as source:
                    places, rows = source.index, []
                    for place, (_, record) in zip(places, source.items(), strict=True):
                        parsed = parse_record(record)
                        rows.append([parsed[n] for n in names] + [bundle, int(place["frame"]), int(place["offset"])])
                        if len(rows) >= 4096:
                            yield _record_batch(rows)
                            rows = []
                    if rows:
                        yield _record_batch(rows)

    return manifest.select("bundle").repartition(max(parts_for(manifest), manifest.count()), "bundle").mapInArrow(read, RECORD)


_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _record_batch(rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = [x.split(" ") for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def read_record(bundle: str, page_id: int) -> list[dict]:
    """The records of one page, from their own frames only."""
    with SeekableReader(bundle) as source:
        return [parse_record(x) for x in source.get(page_id)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    got = read_bundles(write_bundles(documents(spark, sf_dir, "pages"), folder))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS leader FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = leader OR leader IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = leader OR leader IS NULL THEN NULL ELSE leader END AS refers_to
FROM b
"""
