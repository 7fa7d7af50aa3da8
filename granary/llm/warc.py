"""Operator 6: WARC records in bundles of independent zstandard frames, with a map from record to frame and offset."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import apart, small_batches, table, work_dir
from granary.llm.seekable import Reader, Writer

#: Bytes of records that a frame gathers, at least; a longer record has a frame of its own.
FRAME_BYTES = 256 << 10
PLACE = np.dtype([("id", "<i8"), ("frame", "<u4"), ("offset", "<u8"), ("size", "<u8")])

RECORD_ID = "urn:granary:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A response record, or, where refers_to is given, a revisit record without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"{RECORD_ID}{page_id}"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(content: bytes) -> dict:
    """page_id, payload (None in a revisit), payload_bytes, payload_digest, record_type, refers_to of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    own, size, digest = named["WARC-Type"] == "response", int(fields["Content-Length"]), named["WARC-Payload-Digest"].removeprefix("sha1:")
    if own and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{named['WARC-Record-ID']}: its payload differs from its digest")
    refers = named.get("WARC-Refers-To")
    return {
        "page_id": int(named["WARC-Record-ID"].strip("<>").removeprefix(RECORD_ID)),
        "payload": payload if own else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": named["WARC-Type"],
        "refers_to": int(refers.strip("<>").removeprefix(RECORD_ID)) if refers else None,
    }


def bundle_uri(folder: str, bundle: int) -> str:
    return f"{folder}/bundle-{bundle:06d}.warc.zst"


def write_warc(pages: DataFrame, folder: str, *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> list[dict]:
    """Write pages (page_id, url, html) as bundles; the manifest, an entry a bundle.

    Of the pages with equal payloads of at least least_bytes bytes the one of the smallest page_id is a response
    record, the others are revisits of it. Null html is an empty payload, a null url is written as the record's own id,
    and control characters and spaces in a url are percent-encoded. Rows with a null page_id are left out. Rows that
    share a page_id get a record each; those equal to the response's own id are responses too. No pages: no bundles.
    """
    small_batches(pages.sparkSession)
    rows = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html"))
    least = keyed.groupBy("sha").agg(F.min("page_id").alias("first")).select(apart("sha").alias("k"), "first")
    refers = F.when((F.octet_length("html") >= least_bytes) & (F.col("first") != F.col("page_id")), F.col("first"))
    marked = keyed.withColumn("k", F.col("sha")).join(least, "k").select("page_id", "url", "html", "sha", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, writer, held, size, frame, places = TaskContext.get().partitionId(), None, [], 0, 0, []
        for batch in batches:
            for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    writer = Writer(bundle_uri(folder, bundle), level)
                payload = html.encode()
                content = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), len(payload), refers_to, date)
                places.append((page_id, frame, size, len(content)))
                held.append(content)
                size += len(content)
                if size >= FRAME_BYTES:
                    frame = writer.frame(b"".join(held)) + 1
                    held, size = [], 0
        if writer is not None:
            if held:
                writer.frame(b"".join(held))
            writer.close(np.array(places, PLACE).tobytes())
            yield pa.RecordBatch.from_pydict({"bundle": pa.array([bundle], pa.int64()), "n_records": pa.array([len(places)], pa.int64())})

    found = marked.mapInArrow(run, "bundle long, n_records long").collect()  # a row a bundle
    return [{"bundle": r.bundle, "n_records": r.n_records} for r in sorted(found, key=lambda r: r.bundle)]


def read_record(folder: str, bundle: int, page_id: int) -> dict | None:
    """One record of a bundle, from its frame alone; None if the bundle hasn't it."""
    reader = Reader(bundle_uri(folder, bundle))
    try:
        places = np.frombuffer(reader.index, PLACE)
        for p in places[places["id"] == page_id][:1]:
            return parse(reader.frame(int(p["frame"]))[int(p["offset"]) : int(p["offset"]) + int(p["size"])])
        return None
    finally:
        reader.close()


def read_warc(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """All records of the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                reader = Reader(bundle_uri(folder, bundle))
                places = np.frombuffer(reader.index, PLACE)
                cut = np.searchsorted(places["frame"], np.arange(len(reader.entries) + 1))
                for k, content in enumerate(reader.frames()):
                    own = [parse(content[int(p["offset"]) : int(p["offset"]) + int(p["size"])]) for p in places[cut[k] : cut[k + 1]]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in own], schema.field(n).type) for n in names], schema=schema)
                reader.close()

    bundles = [(e["bundle"],) for e in manifest]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(bundles, max(1, min(len(bundles), 10_000))), "bundle long")
    return listed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    return read_warc(spark, folder, write_warc(table(spark, sf_dir, "pages"), folder))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS s, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(s, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM k
"""
