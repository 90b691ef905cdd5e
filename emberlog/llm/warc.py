"""WARC archives with revisit records for repeated payloads.

Only headers (id, url, size, digest) are shuffled, by payload digest, to find the original of each
repeated payload. The records are then made with fresh headers and written through Spark's text sink:
a record is a gzip member of its own, and the sink's separator is an empty gzip member, so the files
are ordinary .warc.gz data and commits and retries are Spark's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm._store import SLICE_BYTES, new_path, slices, spread_join, type_of, written

#: A gzip member without content.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00000000" + "00000000")
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base32, five hexadecimal digits to four letters."""
    digest = F.sha1(payload.cast("binary"))
    four = lambda i: F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[four(i) for i in range(8)]), HEX32, BASE32)


def headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest of each row; a null payload is empty."""
    full = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.octet_length(full).cast("long").alias("payload_bytes"), payload_digest(full).alias("payload_digest"))


def revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, refers_to, refers_to_url of the rows that repeat a payload of ``least_bytes`` or more.

    The row with the largest page_id is the original. Rows that repeat that id, and null ids, are originals too.
    """
    some = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = some.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    rows = spread_join(some, first, "payload_digest", "page_id").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    # the url of an original is looked up for those that are referred to; a repeated page_id has one of its urls
    urls = heads.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("url").alias("refers_to_url"))
    urls = urls.join(first, ["refers_to", "payload_digest"], "left_semi").groupBy("refers_to", "payload_digest").agg(F.max("refers_to_url").alias("refers_to_url"))
    return spread_join(written(rows, "warc_repeats"), urls.drop("refers_to"), "payload_digest", "page_id")


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def address(url: str | None, page_id: object) -> str:
    """A url that fits a header: spaces, controls and non-ASCII are percent-encoded; a missing one is named by its id."""
    return re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, refers_to_url: str | None, date: str) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP headers of its payload, with the full length, and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {address(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {address(refers_to_url, refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` to files of about ``FILE_BYTES`` under ``path``.

    The revisits are written first, so Spark knows their size when it plans the join that marks them:
    the payloads stay where they are unless the revisits are too many to broadcast.
    """
    heads = written(headers(pages, page_id, url, html), "warc_headers")
    repeats = written(revisits(heads, least_bytes), "warc_revisits")
    mean = heads.agg(F.avg("payload_bytes")).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("html"))).join(repeats, ["page_id", "payload_digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "html", "payload_digest", "refers_to", "refers_to_url")
        for batch in slices(batches, "html"):
            made = [gzip_member(record(i, u, h.encode(), d, to, to_url, date)) for i, u, h, d, to, to_url in zip(*[batch.column(c).to_pylist() for c in names], strict=True)]
            yield pa.record_batch([pa.array(made, pa.binary())], ["record"])

    made = rows.select("page_id", "url", "html", "payload_digest", "refers_to", "refers_to_url").mapInArrow(run, "record binary")
    sink = made.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1000))))
    sink.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def members(data: memoryview) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one at a time; those without content are passed over."""
    while len(data):
        unpacker = zlib.decompressobj(31)
        out = unpacker.decompress(data) + unpacker.flush()
        data = memoryview(unpacker.unused_data)
        if out:
            yield out


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its block, cut by Content-Length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return named, rest[: int(named["content-length"])]


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, payload of each record under ``path``.

    A revisit has a null payload. The digest of each response is checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for data in members(memoryview(content.as_buffer())):
                    h, block = parsed(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
                    digest, response = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{h['warc-record-id']} is damaged")
                    rows.append((h.get("x-page-id"), length, digest, h["warc-type"], h.get("x-refers-to-page-id"), h["warc-target-uri"], payload if response else None))
                    held += len(block) + 500
                    if held > SLICE_BYTES:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    rows = files.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target_uri string, payload binary")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` to ``path`` (a new folder of the shared one unless named) and read the archives back.

    Null payloads are empty, null urls are named by page, repeated rows each have a record; an empty
    table gives an empty one. Other columns of ``pages`` are not read.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write(pages, path, page_id, url, html, least_bytes)
    return read(pages.sparkSession, path, type_of(pages, page_id)).drop("payload")
