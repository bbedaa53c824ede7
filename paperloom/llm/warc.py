"""WARC archives: one gzip member per record, written and read back sequentially.

Writing: a page's payload is its html in UTF-8. Payloads of at least
``min_bytes`` that occur more than once are stored once, as a response under
the smallest page_id; the other pages become revisit records that refer to it.
Records are made in batches, joined to chunks of about ``chunk_bytes`` and written by Spark's text writer, which is given
a chunk without its last byte and appends that byte as line separator: a
member's last byte is the high byte of its 32-bit length, 0 for records below
16 MiB, and a larger record gets an empty member behind it. So archives go to any
file system that Spark can write to, and lost tasks are repeated by its commit
protocol. An archive holds ``per_file`` chunks at most, which bounds its bytes (a larger record is a chunk of its own); the
files are gzip files under Spark's names.

Reading: Spark reads the archives, since only it may reach their store; a task holds one of bounded size and goes through
its members in order. A member is inflated in steps
of ``step`` bytes, its header is parsed, the block is framed by Content-Length
and block and payload digests are checked against the header.

Edge cases: null html is an empty payload; null page_ids are written without an
id, come back null and are last; rows that repeat the smallest page_id are
responses too; an empty table gives an empty result; a damaged record raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small

_CRLF = b"\r\n"


def plan_records(pages: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """page_id, url, payload (binary), digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # only digests of several rows need their first page, combined before the shuffle
    firsts = (
        base.where(F.length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("z"), "page_id")).alias("first"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("_page"))
    )
    firsts = small(scratch.store(firsts, "firsts"))
    joined = base.join(firsts, (F.col("digest") == F.col("_digest")) & (F.length("payload") >= min_bytes), "left")
    again = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_page"))
    return joined.select(
        "page_id", "url", F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"), F.length("payload").cast("long").alias("size"), "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_page")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    """A record's URN; the page id is its lower half."""
    if page_id is None:
        return "<urn:paperloom:none>"
    return f"<urn:paperloom:{page_id}>"


def page_of(urn: str | None) -> int | None:
    got = (urn or "").strip("<>").rpartition(":")[2]
    return int(got) if got.lstrip("-").isdigit() else None


def write_record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A record as gzip member(s)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2
    member = _gzip(data, level)
    return member if member[-1] == 0 else member + _gzip(b"", level)


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, path: str, per_file: int, chunk_bytes: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    member = write_record(r["record_type"], r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"])
                    if held and len(held) + len(member) > chunk_bytes:
                        yield pa.record_batch([pa.array([bytes(held[:-1])], pa.binary())], names=["value"])
                        held.clear()
                    held += member
        if held:
            yield pa.record_batch([pa.array([bytes(held[:-1])], pa.binary())], names=["value"])

    made = records.select("record_type", "page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "value binary")
    (made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none")
     .option("maxRecordsPerFile", per_file).text(path))


class Reader:
    """Records of an archive, one member after another; ``take(n)`` gives the next n bytes of the archive."""

    def __init__(self, data: memoryview, step: int = 1 << 16):
        self.data, self.step, self.at = data, step, 0

    def members(self) -> Iterator[bytearray]:
        while self.at < len(self.data):
            z, out = zlib.decompressobj(31), bytearray()
            while not z.eof:
                chunk = self.data[self.at : self.at + self.step]
                if not chunk:
                    raise ValueError("the archive ends within a record")
                out += z.decompress(chunk)
                self.at += len(chunk)
            self.at -= len(z.unused_data)
            yield out

    def records(self) -> Iterator[dict]:
        for data in self.members():
            if not data:  # the empty member behind a large record
                continue
            end = data.find(b"\r\n\r\n")
            lines = bytes(data[:end]).decode().split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError("no record header")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(head["content-length"])
            block = memoryview(data)[end + 4 : end + 4 + length]
            if len(block) != length or bytes(data[end + 4 + length :]) != _CRLF * 2:
                raise ValueError(f"wrong framing of {head.get('warc-record-id')}")
            if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
                raise ValueError(f"wrong block digest of {head.get('warc-record-id')}")
            cut = bytes(block).find(b"\r\n\r\n")
            http = bytes(block[:cut]).decode("latin-1").lower().split("\r\n")
            size = next(int(x.split(":")[1]) for x in http if x.startswith("content-length:"))
            payload, digest = bytes(block[cut + 4 :]), head["warc-payload-digest"].removeprefix("sha256:")
            if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"wrong payload digest of {head.get('warc-record-id')}")
            yield {"head": head, "payload": payload, "size": size, "digest": digest}


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of all records of the archives."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = [[] for _ in names]
                for r in Reader(memoryview(content.as_buffer())).records():
                    head = r["head"]
                    values = [page_of(head["warc-record-id"]), head.get("warc-target-uri"), r["size"], r["digest"], head["warc-type"], page_of(head.get("warc-refers-to")), r["payload"]]
                    for to, v in zip(rows, values, strict=False):
                        to.append(v)
                    if len(rows[0]) >= 1000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)
                        rows = [[] for _ in names]
                if rows[0]:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 100, per_file: int = 8, chunk_bytes: int = 4 << 20, scratch: Scratch | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) as archives in the shared folder and reads them back, a row per record."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    path = f"{scratch.path}/archives"
    write_archives(plan_records(pages, min_bytes, scratch), path, per_file, chunk_bytes)
    return read_archives(spark, path)
