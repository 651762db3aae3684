"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent zstd frames, each holding whole WARC records up
to ``FRAME_BYTES`` (one record at least), closed by a seek table in a skippable
frame (frame sizes, their number, magic number) as in the zstd seekable format.
The index maps each record to (bundle, frame, offset and length within the
uncompressed frame); a record is read by fetching its frame alone.

Of records with equal payloads of at least ``LEAST`` bytes the one with the
largest page_id is a response and the others are revisits that refer to it; all
smaller payloads are responses. Payload digests are made by Spark; what is
shuffled is (page_id, digest, size), and pages are joined with the payloads that
occur more than once, by broadcast behind a check of their number.

Defined cases: payloads of any length are one record, whole in one frame; a null html is an empty payload, a null url an empty one; rows
with the same page_id and payload are all responses if that is the largest
page_id; a null page_id is less than all others, written as -2**63; control
characters of urls are percent-encoded; an empty table gives no bundle; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared

FRAME_BYTES = 1 << 20
LEAST = 1000
BROADCAST_ROWS = 1_000_000
#: Copies from which on a payload is joined by broadcast where not all are: at most one in so many pages.
OFTEN = 10_000
DATE = "2024-01-01T00:00:00Z"
NULL_ID = -(2**63)
#: Of the zstd seekable format. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_size long, offset long, length long"


def record_id(page_id: int) -> str:
    return str(uuid.UUID(int=(0x7475726E_7769_4073 << 64) | (page_id & (1 << 64) - 1)))


def page_of(record: str) -> int:
    low = uuid.UUID(record).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def make_record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response of page ``refers_to``."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: memoryview | bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``."""
    data = bytes(data) if not isinstance(data, bytes) else data
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", begin) + 4
    head["http-length"] = re.search(rb"Content-Length: (\d+)", data[begin:body])[1].decode()
    return head, data[body:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(uri: str) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of the frames of a bundle, from its footer."""
    fs, path = shared._at(uri)
    size = fs.get_file_info(path).size
    n, _, magic = struct.unpack("<IBI", shared.read_bytes(uri, size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError(f"{uri} has no seek table")
    table = np.frombuffer(shared.read_bytes(uri, size - 9 - 8 * n, 8 * n), "<u4").reshape(-1, 2).astype(np.int64)
    at = np.cumsum(table[:, 0]) - table[:, 0]
    return list(zip(at.tolist(), table[:, 0].tolist(), table[:, 1].tolist(), strict=True))


def read_record(uri: str, frame_at: int, frame_size: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; only its frame is fetched."""
    head, payload, _ = parse_record(zstd.ZstdDecompressor().decompress(shared.read_bytes(uri, frame_at, frame_size)), offset)
    return head, payload


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``refers_to`` (null for responses)."""
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_d", F.when(F.octet_length("html") >= LEAST, F.sha1("html")))
    many = rows.filter("_d IS NOT NULL").groupBy("_d").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    many = shared.save(many, "payloads")
    if many.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(many), "_d", "left")
    else:  # pages that can't repeat stay where they are; few payloads repeat often, so these are broadcast
        limit = max(OFTEN, many.agg(F.sum("_n")).first()[0] // max(BROADCAST_ROWS, 1))  # at most BROADCAST_ROWS payloads have more rows
        often = many.filter(F.col("_n") > limit)
        rest = rows.filter("_d IS NOT NULL").join(F.broadcast(often), "_d", "left")
        known = rest.filter("_first IS NOT NULL").unionByName(rows.filter("_d IS NULL").withColumn("_first", F.lit(None).cast("long")).withColumn("_n", F.lit(None).cast("long")))
        joined = known.unionByName(rest.filter("_first IS NULL").drop("_first", "_n").join(many.filter(F.col("_n") <= limit), "_d", "left"))
    return joined.select("page_id", "url", "html", F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str, level: int = 3) -> DataFrame:
    """Write ``pages`` as bundles below ``path``; returns their index."""
    shared.make_dir(path)

    def run(batches):
        name = f"pages-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.warc.zst"
        packer, out, sizes, at = zstd.ZstdCompressor(level=level, write_checksum=True), None, [], 0
        held: list[tuple[int, int, int]] = []
        buffer = bytearray()

        def flush():
            nonlocal at
            frame = packer.compress(bytes(buffer))
            out.write(frame)
            cols = [list(c) for c in zip(*held, strict=True)]
            n = len(held)
            rows = [cols[0], [name] * n, [len(sizes)] * n, [at] * n, [len(frame)] * n, cols[1], cols[2]]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            sizes.append((len(frame), len(buffer)))
            at += len(frame)
            buffer.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for page, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                out = out or shared.Writer(f"{path}/{name}")
                record = make_record(page.as_py(), url.as_py() or "", html.as_py().encode(), refers_to.as_py())
                if buffer and len(buffer) + len(record) > FRAME_BYTES:
                    yield flush()
                held.append((page.as_py(), len(buffer), len(record)))
                buffer += record
        if out is not None:
            if buffer:
                yield flush()
            out.write(seek_table(sizes))
            out.close()

    return shared.save(typed(pages).select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warcindex")


def read_bundles(index: DataFrame, path: str) -> DataFrame:
    """Every record of the bundles of ``index``, read and parsed frame by frame.

    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        unpack = zstd.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for at, packed, size in frames(f"{path}/{name}"):
                    data, rows, here = unpack.decompress(shared.read_bytes(f"{path}/{name}", at, packed), max_output_size=size), [], 0
                    while here < len(data):
                        head, payload, here = parse_record(data, here)
                        page = page_of(head["WARC-Record-ID"][10:-1])
                        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        refers = page_of(head["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in head else None
                        n = int(head["http-length"])
                        if refers is None and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record of page {page}")
                        rows.append((None if page == NULL_ID else page, n, digest, head["WARC-Type"], refers))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = index.select("bundle").distinct()
    n = files.count()
    return files.repartition(max(n, 1), "bundle").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
