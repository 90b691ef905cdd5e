"""What a journal's write commands leave behind: steps, timers, and the log rows that they make.

A command has ``seq``, the order of all commands, and names a step by instance_id, type and name. Each fold
needs one value for each column of a step, so that a step with many commands is one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP = ["instance_id", "type", "name"]
#: The state after each command; ``ensure`` gives the state that a step of its type begins in.
STATE_AFTER = {"complete": "completed", "fail": "failed", "fail_output": "failed", "retry": "waiting_retry", "timer_done": "completed", "timed_out": "failed"}
#: The log rows of commands; a step that fails because its output can't be written, and a retry, make none.
LOGGED = {"complete": "step.completed", "fail": "step.errored", "timed_out": "wait.timed_out"}
STARTED = {"do": "step.started", "sleep": "sleep.started", "waitForEvent": "wait.started"}


def choice(column: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items()])


def with_first(commands: DataFrame) -> DataFrame:
    """The commands that meet a step, with ``first``, the ``seq`` of the ``ensure`` that made it; what comes before it changes nothing."""
    first = F.min(F.when(F.col("command") == "ensure", F.col("seq"))).over(W.partitionBy(*STEP))
    return commands.withColumn("first", first).where(F.col("seq") >= F.col("first"))


def step_states(commands: DataFrame) -> DataFrame:
    """instance_id, type, name, ordinal, state, output, error of each step.

    commands: seq, instance_id, type, name, ordinal, command, value, error, step_error. The first ``ensure`` makes the step and
    later ones change nothing; each other command sets its columns, the last one wins, and null is a value. What replay throws
    after ``fail`` is ``step_error`` if there is one.
    """
    rows = with_first(commands)
    command, made = F.col("command"), F.col("seq") == F.col("first")
    at = lambda sets: F.when(sets, F.col("seq"))
    state = F.when(command == "ensure", F.when(F.col("type") == "do", "running").otherwise("waiting")).otherwise(choice(command, STATE_AFTER))
    output = F.when(command == "complete", F.col("value"))
    error = F.when(command == "fail", F.coalesce("step_error", "error")).when(command.isin("fail_output", "retry", "timed_out"), F.col("error"))
    return rows.groupBy(*STEP).agg(
        F.min_by("ordinal", "seq").alias("ordinal"), F.max_by(state, at(made | (command != "ensure"))).alias("state"),
        F.max_by(output, at(made | command.isin("complete", "timer_done"))).alias("output"), F.max_by(error, at(made | (command != "ensure"))).alias("error"),
    )


def command_log(commands: DataFrame) -> DataFrame:
    """seq, instance_id, kind, name: the log rows of the commands. A step starts once; only a sleep's end is logged when its timer is done."""
    started = F.when(F.col("seq") == F.col("first"), choice(F.col("type"), STARTED))
    slept = F.when((F.col("command") == "timer_done") & (F.col("type") == "sleep"), "sleep.completed")
    kind = F.when(F.col("command") == "ensure", started).otherwise(F.coalesce(slept, choice(F.col("command"), LOGGED)))
    return with_first(commands).select("seq", "instance_id", kind.alias("kind"), "name").where("kind is not null")


def timers(commands: DataFrame) -> DataFrame:
    """instance_id, type, name, kind, wake_at of the timers that are set after all commands (seq, ..., kind, command, wake_at).

    ``put`` sets a timer anew, ``delete`` ends it, and ``wait_on`` sets one only where there is none, so a wait that is
    replayed keeps its deadline.
    """
    key = [*STEP, "kind"]
    last_end = F.max(F.when(F.col("command") == "delete", F.col("seq"))).over(W.partitionBy(*key))
    rows = commands.withColumn("_end", last_end).where(F.col("_end").isNull() | (F.col("seq") > F.col("_end")))
    at = lambda name: F.when(F.col("command") == name, F.col("seq"))
    return rows.groupBy(*key).agg(F.coalesce(F.max_by("wake_at", at("put")), F.min_by("wake_at", at("wait_on"))).alias("wake_at"))


def last_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each of ``keys``: what upserts in ``order`` leave."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
