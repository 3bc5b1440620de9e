"""WARC archives: write pages as records, segment long ones, read archives back and reassemble."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.llm import text as tx
from taskspan.sources.stage import stage, stage_path

VERSION = "WARC/1.1"
SEGMENT_BYTES = 1 << 16  # content of one record; longer blocks go on in continuation records
CHUNK_BYTES = 1 << 13
FILE_RECORDS = 2_000  # records of one archive file, so a file has at most 128 MB and a bit
LEAST_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # fixed, so a rerun writes the same bytes
_END = "\r\n\r\n"

RECORDS = """record_id string, record_type string, target_uri string, payload_digest string,
    refers_to string, page_id long, segment_number long, segment_origin string,
    total_length long, block binary"""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(body[at:at + size]), body[at:at + size])
             for at in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if framed[at:at + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(framed[end + 2:at])
        at += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line ends behind it, which the text sink writes."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def page_records(row: int, page_id: int | None, url: str | None, payload: bytes, sha: str,
                 first_row: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response, its continuations if it is long, or a revisit."""
    own = _id(row, page_id)
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Page-ID", page_id),
              ("WARC-Target-URI", " ".join(url.split()) if url else None)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first_row is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common,
                       ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(first_row)),
                       ("Content-Type", "application/http; msgtype=response")], head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    own = _id(row)
    for number, piece in enumerate(pieces, 1):
        kind, last = ("response" if number == 1 else "continuation"), number == len(pieces)
        segment = [] if len(pieces) == 1 else [
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Origin-ID", own if number > 1 else None),
            ("WARC-Segment-Total-Length", len(block) if last else None)]
        yield _record([("WARC-Type", kind), ("WARC-Record-ID", own if number == 1 else _id(row, "s", number)),
                       *common, *segment,
                       ("Content-Type", "application/http; msgtype=response")], piece)


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES,
                   least_bytes: int = LEAST_REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write one record per row of `pages` (page_id, url, html) as gzipped WARC files under `folder`.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is
    a response (null last; of repeated rows one); the others become revisits that refer to it and
    hold no payload. The pages are stored once, with digest; only row numbers and digests are joined
    and the few columns of the revisits go back to the pages.

    Null html is an empty payload, a null url or page_id leaves out its field.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    stored = stage(pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload")
    ).withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload")), "pages")
    narrow = stored.filter(F.col("size") >= least_bytes).select("row", "page_id", "sha", "size")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = narrow.groupBy("sha", "size").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = narrow.join(first, ["sha", "size"]).filter(F.col("row") != F.col("first.row")).select(
        "row", F.col("first.row").alias("first_row"))
    revisits = stage(revisits, "revisits")
    rows = stored.drop("sha", "size").join(revisits, "row", "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for row, page_id, url, body, first_row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in page_records(row, page_id, url, body, digest(body), first_row,
                                           segment_bytes):
                    made.append(record)
                    size += len(record)
                if size > tx.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    rows = rows.select("row", "page_id", "url", "payload", "first_row")
    lines = rows.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    # a record ends in two line ends, which is what this sink puts behind each value
    lines.write.option("lineSep", _END).option("maxRecordsPerFile", file_records).option(
        "compression", "gzip").text(folder)


def parsed(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, by their Content-Length."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:20]!r}")
        fields = {}
        while (line := stream.readline().decode("utf-8", "replace").rstrip("\r\n")):
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))
        stream.read(len(_END))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in `folder`, gzipped or not; segments are not yet joined."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    names = [x.split()[0] for x in RECORDS.split(",")]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 10, kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                stream = io.BytesIO(content.as_buffer())
                if stream.getbuffer()[:2] == b"\x1f\x8b":  # unpacked bit by bit, record by record
                    stream = gzip.open(stream)
                for f, block in parsed(stream):
                    rows.append((
                        f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"),
                        f.get("warc-payload-digest", "").rpartition(":")[2] or None,
                        f.get("warc-refers-to"), number(f.get("warc-page-id")),
                        number(f.get("warc-segment-number")), f.get("warc-segment-origin-id"),
                        number(f.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > tx.SLICE_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    return files.mapInArrow(read, RECORDS)


def _payload(block: bytes) -> tuple[bytes, str]:
    """The payload of an HTTP message and "ok", or what is wrong with it."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b"", "no header end"
    if b"transfer-encoding: chunked" not in head.lower():
        return body, "ok"
    try:
        return dechunked(body), "ok"
    except ValueError:
        return b"", "bad chunk framing"


def reassembled(records: DataFrame) -> DataFrame:
    """One row per response or revisit record, with its whole payload and a status.

    Only segmented records are shuffled: they are grouped by the identifier of their first record,
    put in order of segment number, and joined if the numbers run from 1 without gaps and the length
    is the total that the last one states. A repeated segment counts once. status: ok, missing
    segment, wrong length, no header end, bad chunk framing, or wrong digest; a payload that is not
    ok is empty. A record's own size bounds what one group holds. Revisits have empty payloads.
    """
    plain = records.filter("segment_number is null").select(
        "record_id", "record_type", "target_uri", "payload_digest", "refers_to", "page_id",
        "block", F.lit("ok").alias("status"))
    parts = records.filter("segment_number is not null").withColumn(
        "origin", F.coalesce("segment_origin", "record_id"))
    pieces = F.array_sort(F.collect_set(F.struct("segment_number", "block")))
    head = F.col("segment_number") == 1
    joined = parts.groupBy("origin").agg(
        pieces.alias("pieces"), F.max("total_length").alias("total"),
        *(F.max(F.when(head, F.col(c))).alias(c)
          for c in ("record_type", "target_uri", "payload_digest", "refers_to", "page_id")))
    numbers = F.transform("pieces", lambda p: p["segment_number"])
    whole = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    complete = numbers == F.sequence(F.lit(1).cast("long"), F.size("pieces").cast("long"))
    joined = joined.withColumn("block", whole).select(
        F.col("origin").alias("record_id"), "record_type", "target_uri", "payload_digest",
        "refers_to", "page_id", "block",
        F.when(~complete | F.col("total").isNull() | F.col("record_type").isNull(), "missing segment")
        .when(F.octet_length("block") != F.col("total"), "wrong length").otherwise("ok")
        .alias("status"))
    out = """record_id string, record_type string, target_uri string, payload_digest string,
        refers_to string, page_id long, status string, payload binary, actual_digest string"""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, states, digests = [], [], []
            for kind, stated, block, state in zip(*(batch.column(c).to_pylist() for c in (
                    "record_type", "payload_digest", "block", "status"))):
                payload = b""
                if state == "ok" and kind != "revisit":
                    payload, state = _payload(block)
                sha = digest(payload) if kind != "revisit" else stated
                if state == "ok" and stated and sha != stated:
                    payload, state = b"", "wrong digest"
                payloads.append(payload)
                states.append(state)
                digests.append(sha)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("record_id", "record_type", "target_uri",
                                             "payload_digest", "refers_to", "page_id")),
                 pa.array(states, pa.string()), pa.array(payloads, pa.binary()),
                 pa.array(digests, pa.string())],
                names=["record_id", "record_type", "target_uri", "payload_digest", "refers_to",
                       "page_id", "status", "payload", "actual_digest"])

    return plain.unionByName(joined).mapInArrow(decode, out)


def page_index(pages: DataFrame) -> DataFrame:
    """One row per response or revisit of `reassembled`, revisits with the size of the payload that
    their response holds: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id).

    Sizes are taken before the join, so no payload is shuffled. A revisit whose response is not in
    the archives keeps its own digest and has null payload_bytes and refers_to.
    """
    index = stage(pages.select(
        "record_id", "record_type", "refers_to", "page_id", "status",
        F.col("actual_digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes")), "index")
    responses = index.filter("record_type = 'response'").drop("refers_to")
    target = responses.select(F.col("record_id").alias("refers_to"),
                              F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("b"))
    revisits = index.filter("record_type = 'revisit'").drop("payload_bytes").join(
        target, "refers_to", "left").select(
        "page_id", F.col("b").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("first_page").alias("refers_to"), "status")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("long").alias("refers_to"), "status").unionByName(revisits)


def archived(pages: DataFrame, **settings) -> DataFrame:
    """Write `pages` to archives under the shared folder, read them back and index them."""
    spark = pages.sparkSession
    folder = stage_path(spark, "archives")
    write_archives(pages, folder, **settings)
    return page_index(reassembled(read_records(spark, folder)))
