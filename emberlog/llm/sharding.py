"""Sharding by fixed virtual slots, in DataFrame functions only.

Rows are hashed into thousands of virtual slots once and for all; the bytes of each slot decide the
shard that holds it. The map from slots to shards is a small versioned table: rebalancing appends a
version that moves few slots, and never rehashes a row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm._store import new_path, written

SLOTS = 8192
OVERHEAD = 16
MAP = "version long, virtual_slot int, shard int, bytes long, rows long, first_slot long"


def virtual_slot(doc_id: str, text: Column, slots: int) -> Column:
    """By id and text, so that rows that share an id, or have none, are dealt out too; only equal rows go together."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.crc32(text.cast("binary"))), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and ``OVERHEAD``), text_crc32, virtual_slot of each row; a null text has no bytes."""
    full = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(full) + OVERHEAD).cast("long").alias("size"),
        F.crc32(full.cast("binary")).alias("text_crc32"),
        virtual_slot(doc_id, full, slots).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by virtual slot; at most as many entries as there are virtual slots."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in found}


def assign(sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Slots by falling bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, (size, _) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return out


def rebalance(sizes: dict[int, tuple[int, int]], old: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """``old``, edited for new sizes or more shards: slots leave shards that are over their share, largest that fits first.

    Ends when no shard exceeds the mean by ``tolerance``, or no move narrows the gap. Slots without an old shard are placed first.
    """
    out = {s: old[s] for s in sizes if old.get(s, shards) < shards}
    total = [0] * shards
    for slot, shard in out.items():
        total[shard] += sizes[slot][0]
    for slot in sorted(sizes.keys() - out.keys(), key=lambda s: (-sizes[s][0], s)):
        out[slot] = shard = min(range(shards), key=lambda s: (total[s], s))
        total[shard] += sizes[slot][0]
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot in sorted(out, key=lambda s: (-sizes[s][0], s)):
        held[out[slot]].append(slot)
    mean = sum(total) / shards if shards else 0
    for _ in range(len(sizes)):
        full, free = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[full] - total[free]
        slot = next((s for s in held[full] if 0 < sizes[s][0] < gap), None)
        if total[full] <= mean * (1 + tolerance) or slot is None:
            break
        held[full].remove(slot)
        held[free].append(slot)
        held[free].sort(key=lambda s: (-sizes[s][0], s))
        out[slot] = free
        total[full] -= sizes[slot][0]
        total[free] += sizes[slot][0]
    return out


def store_map(spark: SparkSession, path: str, version: int, sizes: dict[int, tuple[int, int]], shard_of: dict[int, int]) -> DataFrame:
    """Append one version of the map to the table at ``path`` and read that version back."""
    placed: dict[int, int] = {}
    rows = []
    for slot in sorted(shard_of):
        size, count = sizes[slot]
        shard = shard_of[slot]
        rows.append((version, slot, shard, size, count, placed.get(shard, 0)))
        placed[shard] = placed.get(shard, 0) + count
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest unless named."""
    table = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` of ``slotted`` with ``shard`` and ``slot``, their place in it without gaps.

    The map has a row for each virtual slot, so it is broadcast. Places are counted inside virtual
    slots, of which each shard holds hundreds, and start where the slots before them end.
    """
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    small = F.broadcast(slot_map.select("virtual_slot", "shard", "first_slot"))
    numbered = rows.withColumn("_n", F.row_number().over(within).cast("long") - 1)
    return numbered.join(small, "virtual_slot").withColumn("slot", F.col("first_slot") + F.col("_n")).drop("_n", "first_slot")


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot for each row of ``docs``, by law ``bytes``.

    With ``map_path`` of an earlier call the newest map there is rebalanced, else a first one is
    written. Null ids hash like any value and repeated rows each have a place; an empty table gives an
    empty one. One row is never divided, and rows equal in id and text share a virtual slot: a shard
    exceeds its share by at most the size of one slot. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, doc_id, text, slots), "slotted")
    sizes = slot_sizes(rows)
    old, version = {}, 0
    if map_path:
        newest = read_map(spark, map_path)
        version = newest.agg(F.max("version")).first()[0] + 1
        old = {r["virtual_slot"]: r["shard"] for r in newest.collect()}
    shard_of = rebalance(sizes, old, shards) if old else assign(sizes, shards)
    return placed(rows, store_map(spark, map_path or new_path(spark, "slot_map"), version, sizes, shard_of))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> None:
    """Write ``docs`` with a folder for each shard; rows of a virtual slot stay together.

    Null texts and ids hash like any value, repeated rows are all written, an empty table writes no
    folder. The rows are kept as structs named ``doc``, so their columns may have any names.
    """
    slot = virtual_slot(doc_id, F.coalesce(F.col(text), F.lit("")), slots)
    keyed = docs.select(F.struct("*").alias("doc"), slot.alias("virtual_slot")).join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    keyed.repartition("shard", "virtual_slot").write.partitionBy("shard").parquet(path)
