"""Views with the columns of a journal over the star-schema tables.

The tables have no meaning as a journal; each view only gives columns of the right shape. Times are
whole milliseconds since 1970, UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.kernel import epoch_ms
from emberlog.operators.coverage import probe_verdict

DAY_MS = 86_400_000
#: No two rows of an instance are equal in all of these, so numbering by them is settled.
STEP_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(column: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items()])


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, workflow, status, created_at, lease_owner, lease_expires_at."""
    created = epoch_ms(F.col("o_orderdate"))
    owner = F.when(F.col("o_custkey") % 3 == 1, "exec-a").when(F.col("o_custkey") % 3 == 2, "exec-b")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("workflow"),
        choice(F.col("o_orderstatus"), {"F": "queued", "O": "waiting", "P": "rollingBack"}).alias("status"),
        created.alias("created_at"), owner.alias("lease_owner"),
        F.when(owner.isNotNull(), created + (F.col("o_orderkey") % 400) * DAY_MS).alias("lease_expires_at"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, type, name, state, value, created_at and the sort keys ``STEP_ORDER``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"),
        choice(F.col("l_returnflag"), {"R": "do", "A": "sleep", "N": "waitForEvent"}).alias("type"),
        F.col("l_linestatus").alias("name"),
        F.when(F.col("l_quantity") <= 10, "failed").when(F.col("l_quantity") <= 20, "waiting_retry").otherwise("completed").alias("state"),
        epoch_ms(F.col("l_shipdate")).alias("created_at"), *STEP_ORDER,
    )


def numbered_steps(rows: DataFrame) -> DataFrame:
    """``steps`` with ``ordinal`` (start order in the instance) and ``count`` (of its type and name), both from 1."""
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy("instance_id").orderBy(*STEP_ORDER))).withColumn(
        "count", F.row_number().over(W.partitionBy("instance_id", "type", "name").orderBy(*STEP_ORDER))
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, instance_id, kind, detail, value, created_at: the append-only log."""
    kinds = {"view": "step.started", "click": "attempt.started", "purchase": "step.completed", "error": "attempt.errored", "signup": "workflow.completed"}
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("instance_id"), choice(F.col("event_type"), kinds).alias("kind"),
        F.col("props").alias("detail"), F.col("value"), epoch_ms(F.col("ts")).alias("created_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, container, fingerprint of an inventory."""
    print_of = F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")), 256)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("container"), print_of.alias("fingerprint"))


def baseline(current: DataFrame) -> DataFrame:
    """An older state of ``items``: some ids not there yet, some since removed, some with another fingerprint."""
    old = current.where(F.col("id") % 7 != 0).withColumn("fingerprint", F.when(F.col("id") % 11 == 0, F.lit("old")).otherwise(F.col("fingerprint")))
    gone = current.where(F.col("id") % 13 == 0).withColumn("id", F.col("id") + 100_000_000)
    return old.unionByName(gone)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe, profile, requirement, verdict: a probe for each document."""
    error = F.when((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0), "failed")
    verdict = probe_verdict(F.col("quality").isNotNull(), error, F.col("toxic") == 1, F.col("doc_id") % 17 == 0)
    verdict = F.when((verdict == "VERIFIED") & (F.col("doc_id") % 19 == 0), "UNSUPPORTED").otherwise(verdict)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("probe"), F.col("lang").alias("profile"), F.concat_ws(".", "lang", "source", (F.col("doc_id") % 10).cast("string")).alias("requirement"), verdict.alias("verdict"))
