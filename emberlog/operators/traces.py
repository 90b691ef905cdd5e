"""Event logs folded to traces, and traces compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIFECYCLE = ("step.started", "workflow.completed")


def normalized(log: DataFrame) -> DataFrame:
    """instance_id, events, lifecycle, attempts, errors, last_detail of each instance, in the order of ids."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "kind")))
    kinds = F.transform("_o", lambda x: x["kind"])
    out = log.groupBy("instance_id").agg(ordered.alias("_o"), F.max_by("detail", "id").alias("last_detail"))
    stable = F.filter(kinds, lambda k: k.isin(*LIFECYCLE))
    of = lambda name: F.size(F.filter(kinds, lambda k: k == name)).cast("long")
    return out.select("instance_id", F.size("_o").cast("long").alias("events"), F.array_join(stable, ",").alias("lifecycle"), of("attempt.started").alias("attempts"), of("attempt.errored").alias("errors"), "last_detail")


def differences(expected: DataFrame, actual: DataFrame, key: str, exact: list[str], duration: str | None = None, tolerance: float = 100.0) -> DataFrame:
    """key, outcome: equal, different, or the side that is missing. Durations may differ by ``tolerance`` and no more."""
    e, a = expected.alias("e"), actual.alias("a")
    same = F.lit(True)
    for c in exact:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    if duration:
        same = same & F.coalesce(F.abs(F.col(f"e.{duration}") - F.col(f"a.{duration}")) <= tolerance, F.col(f"e.{duration}").eqNullSafe(F.col(f"a.{duration}")))
    both = e.withColumn("_e", F.lit(True)).alias("e").join(a.withColumn("_a", F.lit(True)).alias("a"), key, "full")
    return both.select(key, F.when(F.col("_e").isNull(), "missing-expected").when(F.col("_a").isNull(), "missing-actual").when(same, "equal").otherwise("different").alias("outcome"))


def event_counts(log: DataFrame) -> DataFrame:
    """kind, step, n: events by kind and step name."""
    return log.groupBy("kind", F.get_json_object("detail", "$.k").alias("step")).agg(F.count("*").alias("n"))
