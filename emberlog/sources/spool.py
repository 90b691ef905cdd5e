"""Queue spools of JSON lines: messages go out in batches of bounded size and come in as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "queue string, id long, body string, sent_at long"
#: Fixed value: messages in one batch.
BATCH = 100


def batched(messages: DataFrame, size: int = BATCH) -> DataFrame:
    """``messages`` with ``batch``: at most ``size`` messages share one. Batches are made inside tasks, so nothing is shuffled.

    The number has the task in its upper bits, as Spark's row ids have.
    """
    row = F.monotonically_increasing_id()
    task, place = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    return messages.withColumn("batch", F.shiftleft(task, 33) + F.floor(place / size).cast("long"))


def send(messages: DataFrame, path: str) -> None:
    """Append ``messages`` (columns of ``MESSAGE``) to the spool, with a folder for each queue."""
    messages.select("queue", "id", "body", "sent_at").write.mode("append").partitionBy("queue").json(path)


def receive(spark: SparkSession, path: str) -> DataFrame:
    """The spool as a stream: each file once, by the checkpoint of the query that reads it."""
    return spark.readStream.schema(MESSAGE).option("mode", "PERMISSIVE").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path)


def settled(messages: DataFrame, results: DataFrame, retries: int) -> DataFrame:
    """queue, id, outcome, tries of each message: acked once any try was, dead after more than ``retries`` retries, else pending.

    results: queue, id, acked. A message that comes twice is one message.
    """
    tries = results.groupBy("queue", "id").agg(F.count("*").alias("tries"), F.bool_or("acked").alias("_ok"))
    out = messages.select("queue", "id").distinct().join(tries, ["queue", "id"], "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    return out.select("queue", "id", F.when(F.col("_ok"), "acked").when(F.col("tries") > retries, "dead").otherwise("pending").alias("outcome"), "tries")
