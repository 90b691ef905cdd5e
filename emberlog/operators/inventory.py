"""Differences of inventories, merges with a baseline, closures and drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change: added, removed or changed; equal rows are left out."""
    left = old.select(key, F.struct(*fields).alias("_old"))
    right = new.select(key, F.struct(*fields).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return left.join(right, key, "full").select(key, change.alias("change")).where("change is not null")


def merge_baseline(old: DataFrame, new: DataFrame, key: str, run: str) -> DataFrame:
    """key, fingerprint, first_seen, last_seen, removed: fields are refreshed, first_seen is kept,
    what vanished gets a tombstone and what came back loses it. old: key, fingerprint, first_seen, last_seen, removed."""
    both = old.alias("o").join(new.alias("n"), key, "full")
    there = F.col("n.fingerprint").isNotNull()
    return both.select(
        key, F.coalesce("n.fingerprint", "o.fingerprint").alias("fingerprint"), F.coalesce(F.col("o.first_seen"), F.lit(run)).alias("first_seen"),
        F.when(there, F.lit(run)).otherwise(F.col("o.last_seen")).alias("last_seen"), (~there).alias("removed"),
    )


def closure(roots: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, depth, via: all nodes that the roots reach, each at its least depth by its least predecessor.

    Each round joins only the new frontier; ``keep`` writes its result so that plans stay short.
    """
    seen = keep(roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("via")).dropDuplicates(["node"]), "closure")
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("via"))
        frontier = keep(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "via"), "closure")
        seen = keep(seen.unionByName(frontier), "closure")
    return seen


def drift_lifecycle(observations: DataFrame, key: str, order: str, present: str) -> DataFrame:
    """Each observation with its state: new, open while present, resolved once gone, recurred when back; never seen is null."""
    over = W.partitionBy(key).orderBy(order)
    before = F.coalesce(F.max(F.col(present).cast("int")).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    last = F.coalesce(F.lag(present).over(over), F.lit(False))
    here = F.col(present)
    state = F.when(here & ~before, "new").when(here & last, "open").when(here, "recurred").when(before, "resolved")
    return observations.withColumn("state", state)


def version_at_least(version: Column, least: Column) -> Column:
    """Dotted triples by number; a missing version counts as new enough."""
    triple = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    return F.coalesce(triple(version) >= triple(least), F.lit(True))


def prefix_page(keys: DataFrame, prefix: str, after: str, limit: int, now: int) -> DataFrame:
    """A page of a key-value listing: live keys with the prefix after a cursor, in order; the limit is the page's."""
    rows = keys.where(F.col("key").startswith(prefix) & (F.col("key") > after) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return rows.orderBy("key").limit(limit)


def delimited(keys: DataFrame, delimiter: str) -> DataFrame:
    """prefix, objects: keys grouped by what comes up to the delimiter, as folders."""
    cut = F.when(F.instr("key", delimiter) > 0, F.concat(F.substring_index("key", delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    return keys.groupBy(cut.alias("prefix")).agg(F.count("*").alias("objects"))
