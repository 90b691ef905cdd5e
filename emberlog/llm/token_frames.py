"""Token ids in binary files of independent zstandard frames with a trailing seek table.

Each frame holds the ids of some documents in a row. A skippable frame lists the documents, and the
file ends with a seek table in the seekable format of zstandard: sizes and a checksum for each frame.
Any zstandard reader can decompress a file; one that knows the table decompresses single frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm._store import new_path, running_starts, slices, type_of, written
from emberlog.llm._tokens import default_tokenizer, encoder

#: Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: The end of every file. The text sink of Spark writes it after each record, and each record is a file.
TAIL = struct.pack("<BI", CHECKSUMS, SEEK_MAGIC)
FRAME_TOKENS, FILE_TOKENS = 1 << 15, 1 << 22
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("tokens", "<u8")])


def file_bytes(part: int, number: int, docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file without its ``TAIL``: frames, document index, seek table."""
    packer, out, table, index = zstandard.ZstdCompressor(level=3), [], [], np.zeros(len(docs), INDEX)
    frame: list[bytes] = []

    def close() -> None:
        data = b"".join(frame)
        out.append(packer.compress(data))
        table.append((len(out[-1]), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        frame.clear()

    held = 0
    for i, (doc_id, ids) in enumerate(docs):
        index[i] = (doc_id or 0, doc_id is not None, len(table), len(ids) // 4)
        frame.append(ids)
        held += len(ids) // 4
        if held >= FRAME_TOKENS:
            close()
            held = 0
    if frame:
        close()
    head = struct.pack("<IIQ", part, number, len(docs)) + index.tobytes()
    out.append(struct.pack("<II", SKIPPABLE, len(head)) + head)
    table.append((len(out[-1]), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    entries = b"".join(struct.pack("<III", *x) for x in table)
    out.append(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<I", len(table)))
    return b"".join(out)


class TokenFile:
    """A file's seek table and document index; ``ids`` decompresses one frame and checks it."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        frames, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        table = np.frombuffer(self.data[-9 - 12 * frames : -9], "<u4").reshape(-1, 3).astype(np.int64)
        self.size, self.checksum = table[:, 0], table[:, 2]
        self.begin = np.cumsum(self.size) - self.size
        head = self.data[int(self.begin[-1]) + 8 : int(self.begin[-1] + self.size[-1])]
        self.part, self.number, n = struct.unpack("<IIQ", head[:16])
        self.index = np.frombuffer(head[16:], INDEX, n)
        self.local_start = np.cumsum(self.index["tokens"]) - self.index["tokens"]

    def frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.data[int(self.begin[k]) : int(self.begin[k] + self.size[k])])
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checksum[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """The place in the index and the ids of each document, or of the wanted ones: only their frames are read."""
        take = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index["doc_id"], list(wanted)) & (self.index["known"] == 1))
        open_frame, data = -1, b""
        for i in take.tolist():
            k = int(self.index["frame"][i])
            if k != open_frame:
                open_frame, data = k, self.frame(k)
                first = int(self.local_start[np.searchsorted(self.index["frame"], k)])
            at = 4 * (int(self.local_start[i]) - first)
            yield i, data[at : at + 4 * int(self.index["tokens"][i])]


def files(tokenizer: str, end_id: int, file_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, docs, end = TaskContext.get().partitionId(), 0, 0, [], end_id.to_bytes(4, "little")
        known = encoder(tokenizer)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = known.ids(text)
                docs.append((doc_id, ids + end))
                held += len(ids) // 4 + 1
                if held >= file_tokens:
                    yield pa.record_batch([pa.array([file_bytes(part, number, docs)], pa.binary())], ["file"])
                    number, held, docs = number + 1, 0, []
        if docs:
            yield pa.record_batch([pa.array([file_bytes(part, number, docs)], pa.binary())], ["file"])

    return run


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> None:
    """Write the ids of all rows of ``docs`` by rising doc_id (nulls first; then by text) to files under ``path``.

    Texts are dealt out by ranges of doc_id and encoded in order. A file has ``file_tokens`` ids or one
    document more; its bytes are one record for Spark's text sink, so commits and retries are Spark's.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(files(tokenizer or default_tokenizer(), end_id, file_tokens), "file binary")
    sink = made.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    sink.option("lineSep", TAIL.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def opened(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content of each file under ``paths``; empty parts are left out."""
    return spark.read.format("binaryFile").load(list(paths)).where("length > 9").select("path", "content")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            f = TokenFile(data.as_buffer())
            crc = [zlib.crc32(ids) for _, ids in f.documents()]
            n = len(f.index)
            yield pa.record_batch(
                [
                    pa.array([f.part] * n, pa.int32()), pa.array([f.number] * n, pa.int32()), pa.array(f.index["doc_id"].astype(np.int64), mask=f.index["known"] == 0),
                    pa.array(f.local_start.astype(np.int64)), pa.array(f.index["tokens"].astype(np.int64)), pa.array(crc, pa.int64()),
                ],
                ["part", "number", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def describe(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files under ``path``, read from the frames.

    The files are read once: their sizes come from the narrow rows, which are written first.
    """
    rows = written(opened(spark, path).select("content").mapInArrow(digests, "part int, number int, doc_id long, local_start long, n_tokens long, ids_crc32 long"), "token_digests")
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("total"))
    parts = running_starts(sizes.groupBy("part").agg(F.sum("total").alias("part_total")), "part", "part_total").select("part", "base")
    before = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0)))
    bases = sizes.join(parts, "part").select("part", "number", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = [x["doc_id"][x["known"] == 1] for x in (TokenFile(data.as_buffer()).index for data in batch.column("content"))]
        ends = [(int(x.min()), int(x.max())) if len(x) else (None, None) for x in known]
        columns = [batch.column("path"), *[pa.array([e[k] for e in ends], pa.int64()) for k in range(2)]]
        yield pa.record_batch(columns, ["path", "first_id", "last_id"])


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """path, first_id, last_id of each file under ``path``: made once, beside the files, in a folder that readers pass over."""
    place = f"{path.rstrip('/')}/_index"
    schema = "path string, first_id long, last_id long"
    opened(spark, path).mapInArrow(ranges, schema).write.mode("ignore").parquet(place)
    return spark.read.schema(schema).parquet(place)


def read(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of the documents asked for, or of all.

    Files whose range holds none of ``doc_ids`` are not opened, and frames without one are not decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    paths = [path]
    if wanted is not None:
        asked = spark.createDataFrame([(i,) for i in sorted(wanted)], "id long")
        found = index_of(spark, path).join(F.broadcast(asked), F.col("id").between(F.col("first_id"), F.col("last_id")), "left_semi")
        paths = [r["path"] for r in found.collect()]  # as many as the documents asked for, more only where ids are repeated
        if not paths:
            return spark.createDataFrame([], "doc_id long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                f = TokenFile(data.as_buffer())
                rows = [(f.index[i], np.frombuffer(ids, "<u4").astype(np.int32)) for i, ids in f.documents(wanted)]
                ids = [int(x["doc_id"]) if x["known"] else None for x, _ in rows]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return opened(spark, *paths).select("content").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` to ``path`` (a new folder of the shared one unless named) and describe the files.

    A null or empty text is the end id alone; repeated rows each are a document; an empty table gives
    an empty one. Other columns of ``docs`` are not read.
    """
    path = path or new_path(docs.sparkSession, "token_files")
    write(docs, path, doc_id, text, tokenizer, end_id)
    return describe(docs.sparkSession, path).select(F.col("doc_id").cast(type_of(docs, doc_id)).alias("doc_id"), "start", "n_tokens", "ids_crc32")
