"""Object stores as folders of files, and key-value pairs as a table of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stat(spark: SparkSession, path: str) -> DataFrame:
    """key, size, modified of each object under ``path``, at any depth; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark names files as URIs: the key is what follows the folder's own path, with escapes undone
    folder = path.rstrip("/").split("://")[-1].removeprefix("file:")
    place = F.instr("path", F.lit(folder + "/")) + len(folder) + 1
    return files.select(F.url_decode(F.regexp_replace(F.expr("path").substr(place, F.length("path")), r"\+", "%2B")).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listed(objects: DataFrame, prefix: str = "", after: str = "", limit: int = 1000) -> DataFrame:
    """A page of keys with the prefix, after the cursor ``after``, in order; the limit is the page's."""
    return objects.where(F.col("key").startswith(prefix) & (F.col("key") > after)).orderBy("key").limit(limit)


def folders(page: DataFrame, prefix: str, delimiter: str) -> DataFrame:
    """prefix, objects: a page's keys grouped by what comes up to the delimiter after ``prefix``.

    The delimiter is applied after the page's limit, so a page can hold fewer entries than its limit.
    """
    rest = F.col("key").substr(F.lit(len(prefix) + 1), F.length("key"))
    cut = F.when(F.instr(rest, delimiter) > 0, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    return page.groupBy(cut.alias("prefix")).agg(F.count("*").alias("objects"))


def live_pairs(versions: DataFrame, now: int) -> DataFrame:
    """key, value, metadata of the last version of each key that is neither deleted nor over at ``now``.

    versions: key, seq, value, metadata, deleted, expires_at. A pair is over once ``expires_at`` is reached.
    """
    last = versions.groupBy("key").agg(F.max_by(F.struct("value", "metadata", "deleted", "expires_at"), "seq").alias("v"))
    there = ~F.coalesce(F.col("v.deleted"), F.lit(False)) & (F.col("v.expires_at").isNull() | (F.col("v.expires_at") > now))
    return last.where(there).select("key", "v.value", "v.metadata")
