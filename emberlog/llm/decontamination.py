"""Benchmark items inside long documents: size-partitioned MinHash containment, verified exactly.

Turning containment into a similarity fails here: an item of 40 words in a text of 20,000 has a
similarity of 0.002. So the sketch of an item, the least of its shingles in a fixed order, is looked up
in the whole shingle set of a document instead. Items are partitioned by size: one with q shingles has a
sketch of q - ceil(t q) + 1, so a document with a share t of them holds at least one of the sketch and
no containment is missed. The order is by how many documents hold a shingle, then by hash, so that
passages which everything shares are looked up last. A document meets only items of the size classes
that it has enough item shingles for. Candidates are then confirmed on all shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm._store import free_name, marked_in, scratch, slices, spread_join, type_of, written
from emberlog.llm._words import Shingles, letter_words

#: Slots of the bitmap of item shingles that each task gets: 1 MiB, whatever the number of items.
BITMAP_BITS = 1 << 23


def needed(size: int, percent: int) -> int:
    """The least number of common shingles that is ``percent`` of ``size``."""
    return -(-percent * size // 100)


def item_sets(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width, letter_words)
        for batch in slices(batches, "text"):
            sets = [shingles.of(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("item_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([needed(len(s), percent) for s in sets], pa.int32()),
                    pa.array([int(math.log2(len(s))) if len(s) else -1 for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["item_id", "item_shingles", "needed", "size_class", "shingles"],
            )

    return run


def hits(width: int, bitmap: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id and those shingles of each document that the bitmap may have; documents with fewer than ``least`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, shingles = np.uint64(BITMAP_BITS - 1), Shingles(width, letter_words)
        for batch in slices(batches, "text"):
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                s = shingles.of(text)
                slot = (s & mask).astype(np.int64)
                s = s[(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                if len(s) >= least:
                    rows.append(i)
                    found.append(s.view(np.int64))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "hits"])

    return run


def bitmap_of(sets: DataFrame) -> np.ndarray:
    """A bit for each slot that an item shingle falls in, gathered in words of 64 bits: ``BITMAP_BITS / 64`` rows at most come to the driver."""
    slot = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))
    bits = F.expr(f"bit_or(shiftleft(1L, cast(h & {63} as int)))")
    words = sets.select(F.explode("shingles").alias("h")).groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(bits.alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, size_class, item_shingles, common of each document that holds ``percent`` of an item's shingles, as a written table.

    Words are runs of letters, digits and underscores, lower-cased, in whole texts; an item of fewer
    than ``width`` words counts as one shingle, which only a text of those words has. Null and empty
    texts and items hold nothing. Repeated rows give one pair; null ids are kept as ids.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        schema = f"item_id {type_of(items, item_id)}, item_shingles int, needed int, size_class int, shingles array<long>"
        sets = keep(named.mapInArrow(item_sets(width, percent), schema).where("item_shingles > 0").withColumn("item", F.monotonically_increasing_id()), "item_sets")
        least = sets.agg(F.min("needed")).first()[0] or 1
        bitmap = spark.sparkContext.broadcast(bitmap_of(sets))
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return hits(width, bitmap.value, least)(batches)

        found = texts.mapInArrow(run, f"doc_id {type_of(docs, doc_id)}, hits array<long>")
        found = keep(found.withColumn("doc", F.monotonically_increasing_id()), "shingle_hits")
        # the size class of the largest items that a document has enough shingles for
        each = keep(found.select("doc", F.size("hits").alias("n_hits"), F.explode("hits").alias("hash")), "each_hit")
        shingles = sets.select("item", "size_class", "item_shingles", "needed", F.explode("shingles").alias("hash"))
        counts = each.join(shingles.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("docs"))
        # a shingle that no document has comes first in the order, and is looked up in vain
        place = F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "hash"))
        ordered = shingles.join(counts, "hash", "left").withColumn("place", place)
        sketches = keep(ordered.where(F.col("place") <= F.col("item_shingles") - F.col("needed") + 1).select("item", "size_class", "needed", "hash"), "item_sketches")
        by_hash = keep(sketches.groupBy("hash", "size_class").agg(F.min("needed").alias("least")), "sketch_classes")
        # only the hits that are in some sketch go on, and meet one size class after the other
        tokens = keep(each.join(by_hash, "hash").where(F.col("n_hits") >= F.col("least")).select("doc", "n_hits", "hash", "size_class"), "sketch_hits")
        pairs = tokens.join(sketches, ["size_class", "hash"]).where(F.col("n_hits") >= F.col("needed")).select("doc", "item").distinct()
        pairs = keep(pairs, "candidate_pairs")
        both = spread_join(pairs, sets.drop("needed"), "item", "doc").join(found, "doc")
        checked = both.withColumn("common", F.size(F.array_intersect("shingles", "hits"))).where(F.col("common") * 100 >= F.col("item_shingles") * percent)
        return written(checked.select("doc_id", "item_id", "size_class", "item_shingles", "common").distinct(), "contained_items")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no item.

    Rows are not joined by an id, which may be null or repeated: a text that holds an item is known by
    its hash, and all rows with it go. Null and empty texts hold nothing and stay, as do repeated rows
    of a clean text. An empty table, or no items, gives the rows as they are. Columns may have any names.
    """
    key = free_name(docs, "_text_hash")
    named = docs.withColumn(key, F.sha2(F.col(text), 256))
    bad = contained(named, items, key, text, width=width, percent=percent).select(F.col("doc_id").alias(key))
    bad = written(bad.distinct(), "contaminated_texts")
    maybe = free_name(named, "_maybe")
    marked = marked_in(named, [F.col(key)], bad, [F.col(key)], maybe)
    clean = marked.where(~F.col(maybe) | F.col(key).isNull())
    return clean.unionByName(marked.where(F.col(maybe) & F.col(key).isNotNull()).join(bad, key, "left_anti")).drop(key, maybe)
