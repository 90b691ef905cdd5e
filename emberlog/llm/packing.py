"""Packing by concatenation and cutting at fixed windows.

All token ids form one long row in the order of partitions and of rows in them. A first pass writes
each document's ids with its start inside its partition; the totals of the partitions, summed up, give
each partition's start in the whole. A second pass cuts at the multiples of the window. Windows that
lie in one run of documents are made there; only the parts of those that cross from one run to the
next, the boundary records, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm._store import running_starts, slices, type_of, written
from emberlog.llm._tokens import default_tokenizer, encoder

PIECE = "doc_id {id}, start long, length long, offset long, doc_tokens long"


def encoded(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, part, local_start, n_tokens, ids: the start counts the ids before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        known = encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids = [known.ids(x) + end for x in batch.column("text").to_pylist()]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            ends = start + np.cumsum(counts)
            starts, start = ends - counts, int(ends[-1]) if len(ends) else start
            columns = [batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])

    return run


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, global_start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {type_of(docs, doc_id)}, part int, local_start long, n_tokens long, ids binary"
    rows = written(rows.mapInArrow(encoded(tokenizer or default_tokenizer(), end_id), schema), "token_rows", "zstd")
    totals = running_starts(rows.groupBy("part").agg(F.sum("n_tokens").alias("total")), "part", "total")
    # a row for each partition of the first pass
    rows = rows.join(F.broadcast(totals.select("part", "base")), "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("global_start"), "n_tokens", "ids")


def windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole windows of each run of documents that follow each other, and the boundary records of the others.

    sequence_id, offset, ids, whole, and for the pieces in it lists of doc_id, start, length, offset, doc_tokens.
    """
    lists = ("piece_doc_id", "piece_start", "piece_length", "piece_offset", "piece_doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = bytearray(), 0  # ids not yet given out, and the place after them
        pieces: list[tuple] = []
        out: list[tuple] = []

        def give() -> None:
            """Close the window or boundary record that is open."""
            if held:
                n = len(held) // 4
                out.append(((at - 1) // window, (at - n) % window, bytes(held), n == window, *map(list, zip(*pieces, strict=True))))
                held.clear()
                pieces.clear()

        def batch_of(id_type: pa.DataType) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(id_type), *[pa.list_(pa.int64())] * 4)
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["sequence_id", "offset", "ids", "whole", *lists])

        id_type = None
        for batch in slices(batches, "ids"):
            id_type = batch.schema.field("doc_id").type
            for doc_id, first, n, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "global_start", "n_tokens", "ids")], strict=True):
                if at != first:
                    give()
                    at = first
                begin = 0
                while begin < n:
                    offset = at % window
                    take = min(n - begin, window - offset)
                    held.extend(ids[4 * begin : 4 * (begin + take)])
                    pieces.append((doc_id, begin, take, offset, n))
                    begin, at = begin + take, at + take
                    if at % window == 0:
                        give()
            yield batch_of(id_type)
        give()
        if out:
            yield batch_of(id_type)

    return run


def sequences(tokens: DataFrame, window: int = 1024) -> DataFrame:
    """sequence_id, length, ids, pieces of each packed sequence of ``token_table``; only the last is not full.

    A boundary window has at most ``window`` ids, so what is grouped by it is bounded.
    """
    id_type = type_of(tokens, "doc_id")
    schema = f"sequence_id long, offset long, ids binary, whole boolean, piece_doc_id array<{id_type}>, piece_start array<long>, piece_length array<long>, piece_offset array<long>, piece_doc_tokens array<long>"
    made = tokens.mapInArrow(windows(window), schema)
    zipped = F.arrays_zip(*[F.col(f"piece_{c}").alias(c) for c in ("doc_id", "start", "length", "offset", "doc_tokens")]).cast(f"array<struct<{PIECE.format(id=id_type).replace(' ', ':').replace(',:', ',')}>>")
    made = written(made.select("sequence_id", "offset", "ids", "whole", zipped.alias("pieces")), "windows", "zstd")
    parts = made.where("not whole").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    joined = parts.select("sequence_id", ids.alias("ids"), F.flatten(F.transform("parts", lambda x: x["pieces"])).alias("pieces"))
    all_of = made.where("whole").select("sequence_id", "ids", "pieces").unionByName(joined)
    return all_of.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "pieces")


def pieces(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids of each piece of ``sequences``."""
    each = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    each = each.select("p.doc_id", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset", ids.alias("ids"))
    return each.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, window: int = 1024) -> DataFrame:
    """The pieces of the packed sequences of all rows of ``docs``, with their ids: each row's ids and ``end_id`` in exactly one place.

    A null or empty text is the end id alone; repeated rows each have pieces; an empty table gives an
    empty one. Only the last sequence can be short. Other columns of ``docs`` are not read.
    """
    return pieces(sequences(token_table(docs, doc_id, text, tokenizer, end_id), window))
