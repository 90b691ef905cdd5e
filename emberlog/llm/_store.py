"""Tables written between jobs, joins on keys that many rows share, and batches bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.sources.shared import new_path, scratch, shared_dir, written

__all__ = ["free_name", "frequent", "let", "marked_in", "new_path", "running_starts", "scratch", "shared_dir", "slices", "spread_join", "type_of", "written"]

#: Bytes of texts that a task works on at once; one text that is longer is worked on alone.
SLICE_BYTES = 2 << 20
#: Bits of the bitmap that a table's keys are looked up in: 131,072 rows of 64 at most, whatever the table's size.
BITMAP_BITS = 1 << 23
#: A key with more than this share of a table's rows, and with more rows than the least, is divided.
SHARE, LEAST_ROWS = 256, 256


def running_starts(totals: DataFrame, order: str, value: str) -> DataFrame:
    """``totals`` with ``base``, the sum of ``value`` in the rows before: for tables with a row for each partition."""
    before = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, where ``value`` is evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose ``column`` has about ``most`` bytes at most.

    Spark bounds its Arrow batches by bytes; what Python makes of them is several times larger, so
    a task takes less at once. No setting of the session is touched.
    """
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 64)
        at = 0
        while at < len(end):
            upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``_parts``, into how many parts to divide it, of each key with over a ``SHARE``-th of ``rows``; to be broadcast.

    Fewer than ``SHARE`` keys can be so frequent. ``rows`` should be a written table, as it is counted first.
    """
    most = max(rows.count() // SHARE, LEAST_ROWS)
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return F.broadcast(many.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` to ``side``, which has one row for each key, however many rows a key has.

    A key with over a ``SHARE``-th of the rows is divided by the hash of ``by``, and its row of ``side``
    repeated once for each part. Rows without a key are dealt out too. ``rows`` should be a written table, as it is counted first.
    """
    many = frequent(rows, key)
    parts = F.when(F.col(key).isNull(), SHARE).otherwise(F.coalesce("_parts", F.lit(1)))
    left = rows.join(many, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = side.join(many, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def marked_in(rows: DataFrame, keys: list[Column], some: DataFrame, some_keys: list[Column], name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where their keys are surely not among ``some_keys`` of ``some``.

    The keys of ``some`` are hashed into a bitmap of a fixed size, which is broadcast. So wide rows that
    have no partner need not be shuffled to find that out; the others are joined as usual afterwards.
    """
    slot = lambda columns: F.xxhash64(*columns).bitwiseAND(F.lit(BITMAP_BITS - 1))
    bits, word = f"{name}_bits", f"{name}_word"
    words = some.select(slot(some_keys).alias("slot")).groupBy(F.shiftright("slot", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias(bits))
    out = rows.withColumn(name, slot(keys)).withColumn(word, F.shiftright(name, 6)).join(F.broadcast(words), word, "left")
    return out.withColumn(name, F.coalesce(F.expr(f"shiftright({bits}, cast({name} & 63 as int)) & 1 = 1"), F.lit(False))).drop(bits, word)
