"""The keyed state machine over a stream of log rows, and the batch fold it must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "instance_id long, status string, attempts long, buffered long, last_id long"
STATE = "status string, attempts long, buffered long, last_id long"


def step(state: tuple[str, int, int, int], row_id: int, kind: str) -> tuple[str, int, int, int]:
    """One transition: a click begins an attempt, an error sends it to wait, an event that nothing waits for is buffered."""
    status, attempts, buffered, last = state
    if status == "complete" or row_id <= last:
        return state
    if kind == "attempt.started":
        return ("waiting" if buffered == 0 else "running"), attempts + 1, max(buffered - 1, 0), row_id
    if kind == "step.completed":
        return ("running", attempts, buffered, row_id) if status == "waiting" else (status, attempts, buffered + 1, row_id)
    if kind == "workflow.completed":
        return "complete", attempts, buffered, row_id
    return status, attempts, buffered, row_id


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of one instance after the rows of a micro-batch, taken by id."""
    now = tuple(state.get) if state.exists else ("running", 0, 0, -1)
    rows = pd.concat([f[["id", "kind"]] for f in frames]).sort_values("id")
    for row_id, kind in rows.itertuples(index=False):
        now = step(now, int(row_id), kind)
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["instance_id", "status", "attempts", "buffered", "last_id"])


def run(log: DataFrame) -> DataFrame:
    """A streaming log (instance_id, id, kind) as updates of instance states; old rows that come again change nothing."""
    return log.groupBy("instance_id").applyInPandasWithState(advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def fold(log: DataFrame) -> DataFrame:
    """The same states from the whole log in batch, as an ordered fold in Catalyst."""
    rows = F.array_sort(F.collect_list(F.struct("id", "kind")))
    start = F.struct(F.lit("running").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(0).cast("long").alias("buffered"), F.lit(-1).cast("long").alias("last_id"))

    def move(s, x):
        done = s["status"] == "complete"
        begins, comes, ends = x["kind"] == "attempt.started", x["kind"] == "step.completed", x["kind"] == "workflow.completed"
        status = F.when(begins, F.when(s["buffered"] == 0, "waiting").otherwise("running")).when(comes & (s["status"] == "waiting"), "running").when(ends, "complete").otherwise(s["status"])
        buffered = F.when(begins, F.greatest(s["buffered"] - 1, F.lit(0))).when(comes & (s["status"] != "waiting"), s["buffered"] + 1).otherwise(s["buffered"])
        after = F.struct(status.alias("status"), (s["attempts"] + begins.cast("long")).alias("attempts"), buffered.alias("buffered"), x["id"].alias("last_id"))
        return F.when(done, s).otherwise(after)

    return log.groupBy("instance_id").agg(F.aggregate(rows, start, move).alias("s")).select("instance_id", "s.*")
