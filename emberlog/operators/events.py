"""The public events of a journal's log, and the traces that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import kernel as K
from emberlog.operators.writes import choice

#: The kinds of log rows that are public, and the types of their events.
PUBLIC_TYPES = {
    "instance.created": "workflow_queued", "instance.started": "workflow_started", "instance.running": "workflow_running",
    "instance.paused": "workflow_paused", "instance.waitingForPause": "workflow_waiting_for_pause", "instance.waiting": "workflow_waiting",
    "instance.complete": "workflow_completed", "instance.errored": "workflow_errored", "instance.terminated": "workflow_terminated",
    "step.started": "step_started", "step.completed": "step_completed", "step.errored": "step_errored",
    "attempt.started": "attempt_started", "attempt.completed": "attempt_completed", "attempt.errored": "attempt_errored",
    "sleep.started": "sleep_started", "sleep.completed": "sleep_completed",
    "wait.started": "wait_started", "wait.completed": "wait_completed", "wait.timed_out": "wait_timed_out",
    "instance.rollback.started": "rollback_started", "rollback.step.started": "rollback_step_started",
    "rollback.attempt.started": "rollback_attempt_started", "rollback.attempt.completed": "rollback_attempt_completed",
    "rollback.attempt.errored": "rollback_attempt_errored", "rollback.step.completed": "rollback_step_completed",
    "rollback.step.errored": "rollback_step_errored", "instance.rollback.complete": "rollback_completed", "instance.rollback.failed": "rollback_errored",
}
#: The message of an error that the log does not describe.
NO_MESSAGE = {"workflow_errored": "Workflow errored", "attempt_errored": "Step attempt errored", "rollback_attempt_errored": "Rollback attempt errored", "rollback_step_errored": "Rollback step failed"}
#: What a trace keeps of an instance's life, and the events that end it.
LIFECYCLE = ("workflow_queued", "workflow_started", "workflow_paused", "workflow_waiting_for_pause", "workflow_completed", "workflow_errored", "workflow_terminated")
FINAL = ("workflow_completed", "workflow_errored", "workflow_terminated")
OF_INSTANCE = ("rollback_started", "rollback_completed", "rollback_errored")
DETAIL = "name string, attempt long, params string, config string, output string, redacted boolean, stream boolean, bytes double, durationMs double, eventType string, retryDelayMs long, error string"


def public_events(log: DataFrame) -> DataFrame:
    """instance_id, event_id, timestamp, type and the fields that events of the type have, of each public row of ``log``.

    log: id, instance_id, kind, detail (JSON), created_at. A detail that is null or no JSON has no fields. A stream's output is
    not shown, a sensitive one is redacted; other outputs, params and configs stay the JSON or text that the log has.
    """
    rows = log.select("instance_id", F.col("id").alias("event_id"), F.col("created_at").alias("timestamp"), choice(F.col("kind"), PUBLIC_TYPES).alias("type"), F.from_json("detail", DETAIL).alias("d"))
    rows = rows.where("type is not null").withColumn("e", F.from_json("d.error", "name string, message string"))
    of = lambda types, value: F.when(F.col("type").isin(*types), value)
    stream = F.coalesce("d.stream", F.lit(False)) & (F.col("type") == "step_completed")
    shown = F.when(stream, None).when((F.col("type") == "step_completed") & F.col("d.redacted"), "[REDACTED]").otherwise(F.col("d.output"))
    described = F.col("d.error").isNotNull()
    return rows.select(
        "instance_id", "event_id", "timestamp", "type",
        F.when(~F.col("type").startswith("workflow_") & ~F.col("type").isin(*OF_INSTANCE), F.col("d.name")).alias("step_name"),
        F.when(F.col("type").contains("attempt_"), F.col("d.attempt")).alias("attempt"),
        of(["workflow_started"], F.col("d.params")).alias("params"), of(["step_started", "rollback_step_started"], F.col("d.config")).alias("config"),
        of(["workflow_completed", "step_completed"], shown).alias("output"), F.when(stream, F.col("d.bytes")).alias("bytes"),
        of(["sleep_started"], F.col("d.durationMs")).alias("duration_ms"), of(["wait_started"], F.col("d.eventType")).alias("event_type"),
        of(["attempt_errored", "rollback_attempt_errored"], F.col("d.retryDelayMs")).alias("retry_delay_ms"),
        of(NO_MESSAGE, F.when(described, F.col("e.name")).otherwise("Error")).alias("error_name"),
        of(NO_MESSAGE, F.when(described, F.col("e.message")).otherwise(choice(F.col("type"), NO_MESSAGE))).alias("error_message"),
    )


def ends(events: DataFrame, instances: DataFrame) -> DataFrame:
    """instance_id, ended_by, last_id of each of ``instances`` (id, status): its feed ends with its first final event, or, without one, by its status."""
    final = events.where(F.col("type").isin(*FINAL)).groupBy("instance_id").agg(F.min("event_id").alias("last_id"))
    rows = instances.select(F.col("id").alias("instance_id"), "status").join(final, "instance_id", "left")
    ended = F.when(F.col("last_id").isNotNull(), "event").when(F.col("status").isin(*K.TERMINAL), "status")
    return rows.select("instance_id", ended.alias("ended_by"), "last_id")


def trace_items(events: DataFrame) -> DataFrame:
    """instance_id, part, position, type, step_name, attempt, event_type, duration_ms: the parts of each instance's trace in order.

    Parts are lifecycle, step (each step has its own positions), rollback_order, rollback_outcome, wait and sleep. Items are rows
    and not lists, so that a long trace is no long row.
    """
    kind, named = F.col("type"), F.coalesce(F.col("step_name") != "", F.lit(False))
    parts = F.array_compact(F.array(
        F.when(kind.isin(*LIFECYCLE), "lifecycle"), F.when(named, "step"), F.when(kind == "rollback_step_started", "rollback_order"),
        F.when(kind.isin("rollback_completed", "rollback_errored"), "rollback_outcome"), F.when(kind.startswith("wait_"), "wait"), F.when(kind.startswith("sleep_"), "sleep"),
    ))
    rows = events.select("instance_id", "event_id", F.explode(parts).alias("part"), "type", "step_name", "attempt", "event_type", "duration_ms")
    place = W.partitionBy("instance_id", "part", F.when(F.col("part") == "step", F.col("step_name"))).orderBy("event_id")
    return rows.withColumn("position", F.row_number().over(place).cast("long")).drop("event_id")


def trace_steps(events: DataFrame) -> DataFrame:
    """instance_id, step_name, first_id, events, attempts, output, error_name, error_message: each step's last output and last error; steps come in the order of first_id."""
    has_output = (F.col("type") == "step_completed") & F.col("output").isNotNull()
    last = lambda value, when: F.max_by(value, F.when(when, F.col("event_id"))).alias(value)
    failed = F.col("error_message").isNotNull()
    return events.where("step_name <> ''").groupBy("instance_id", "step_name").agg(
        F.min("event_id").alias("first_id"), F.count("*").alias("events"), F.count("attempt").alias("attempts"), last("output", has_output), last("error_name", failed), last("error_message", failed),
    )


def run_results(expected: DataFrame, actual: DataFrame, key: str, exact: list[str]) -> DataFrame:
    """key, expected_error, actual_error, differs, passed of two runs (key, error, ...).

    A probe that one side lacks is an error of that side, and a run passes only without errors on both and without differences.
    """
    e, a = expected.withColumn("_e", F.lit(True)).alias("e"), actual.withColumn("_a", F.lit(True)).alias("a")
    differs = F.lit(False)
    for c in exact:
        differs = differs | ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    side = lambda s: F.when(F.col(f"{s}._{s}").isNull(), "missing").otherwise(F.col(f"{s}.error"))
    both = e.join(a, key, "full").select(key, side("e").alias("expected_error"), side("a").alias("actual_error"), differs.alias("_differs"))
    clean = F.col("expected_error").isNull() & F.col("actual_error").isNull()
    return both.select(key, "expected_error", "actual_error", (clean & F.col("_differs")).alias("differs"), (clean & ~F.col("_differs")).alias("passed"))
