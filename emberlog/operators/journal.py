"""Questions over a journal of instances, steps, timers and log rows, each a DataFrame of DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import kernel as K


def runnable(instances: DataFrame, timers: DataFrame, registrations: DataFrame, now: int, executor: str) -> DataFrame:
    """Instances that ``executor`` may run at ``now``: the lease is free, its own or over, and the instance
    is queued or running, waits with any timer due, or rolls back with no registration or one to act on."""
    free = F.col("lease_owner").isNull() | (F.col("lease_owner") == executor) | (F.col("lease_expires_at") <= now)
    open_rows = instances.where(free & F.col("status").isin("queued", "running", "waiting", "rollingBack"))
    due = timers.where(F.col("wake_at") <= now).select(F.col("instance_id").alias("id"))
    waiting = open_rows.where("status = 'waiting'").join(due, "id", "left_semi")
    registered = registrations.groupBy(F.col("instance_id").alias("id")).agg(F.max(F.col("actionable").cast("int")).alias("act"))
    rolling = open_rows.where("status = 'rollingBack'").join(registered, "id", "left").where(F.coalesce("act", F.lit(1)) == 1).drop("act")
    return open_rows.where(F.col("status").isin("queued", "running")).unionByName(waiting).unionByName(rolling)


def page(rows: DataFrame, by: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of each group of ``by`` with ``total``, the rows of the group."""
    numbered = rows.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    totals = rows.groupBy(by).agg(F.count("*").alias("total"))
    return numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).join(totals, by)


def attempt_summary(steps: DataFrame) -> DataFrame:
    """Attempts of each step key: how many, how many failed, the states in order, the last state."""
    order = F.array_sort(F.collect_list(F.struct("ordinal", "state")))
    return steps.groupBy("instance_id", "type", "name").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("state") == "failed").alias("failures"), F.max_by("state", "ordinal").alias("last_state"),
        F.array_join(F.transform(order, lambda x: x["state"]), ",").alias("states"),
    )


def latest_status(log: DataFrame) -> DataFrame:
    """The state of each instance after its last log row."""
    last = log.groupBy("instance_id").agg(F.max_by("kind", "id").alias("kind"), F.max("id").alias("last_id"), F.max("created_at").alias("updated_at"))
    status = F.when(F.col("kind") == "workflow.completed", "complete").when(F.col("kind") == "attempt.errored", "waiting").otherwise("running")
    return last.select("instance_id", "last_id", "updated_at", status.alias("status"))


def status_changes(log: DataFrame) -> DataFrame:
    """Rows whose kind is another than that of the instance's row before."""
    before = F.lag("kind").over(W.partitionBy("instance_id").orderBy("id"))
    return log.withColumn("previous", before).where(F.col("previous").isNull() | (F.col("previous") != F.col("kind"))).select("instance_id", "id", "previous", "kind")


def expires_at(status: Column, ended_at: Column, success_ms: Column, error_ms: Column) -> Column:
    """Only an end sets it: complete and terminated by the success retention, errored by the other; null is never."""
    return F.when(status.isin("complete", "terminated"), ended_at + success_ms).when(status == "errored", ended_at + error_ms)


def expired(instances: DataFrame, now: int) -> DataFrame:
    return instances.where(F.col("expires_at") <= now)


def without(children: DataFrame, doomed: DataFrame) -> DataFrame:
    """The cascade of a delete: children of instances that stay."""
    return children.join(doomed.select(F.col("id").alias("instance_id")), "instance_id", "left_anti")


def first_terminal(log: DataFrame, kinds: tuple[str, ...] = ("workflow.completed",)) -> DataFrame:
    return log.where(F.col("kind").isin(*kinds)).groupBy("instance_id").agg(F.min("id").alias("terminal_id"))


def feed(log: DataFrame, after: int, limit: int, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Each instance's next ``limit`` rows after a cursor, up to its end; the kind filter comes after the end is found."""
    rows = log.join(first_terminal(log), "instance_id", "left").where(F.col("terminal_id").isNull() | (F.col("id") <= F.col("terminal_id")))
    rows = rows.where(F.col("id") > after)
    if wanted:
        rows = rows.where(F.col("kind").isin(*wanted))
    place = F.row_number().over(W.partitionBy("instance_id").orderBy("id"))
    return rows.withColumn("position", place).where(F.col("position") <= limit).drop("terminal_id")


def redacted(log: DataFrame, sensitive: Column) -> DataFrame:
    return log.withColumn("output", F.when(sensitive, F.lit("[REDACTED]")).otherwise(F.col("detail")))


def pair_waits(waits: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th wait of a key takes the k-th event of the key: first in, first out, without timeouts."""
    place = lambda c: F.row_number().over(W.partitionBy(*keys).orderBy(c))
    left, right = waits.withColumn("k", place("wait_id")), events.withColumn("k", place("event_id"))
    return left.join(right, [*keys, "k"], "left")


def restart_survivors(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """The steps that a restart keeps: those before the target's ordinal; without a target, of the instances not restarted, all."""
    rows = steps.join(targets.select("instance_id", F.col("ordinal").alias("target")), "instance_id", "left")
    return rows.where(F.col("target").isNull() | (F.col("ordinal") < F.col("target"))).drop("target")


def rollback_plan(registrations: DataFrame) -> DataFrame:
    """The order of compensation, last started first; what follows the first failure does not run."""
    order = W.partitionBy("instance_id").orderBy(F.desc("ordinal"))
    failed_before = F.coalesce(F.max(F.col("failed").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return registrations.withColumn("position", F.row_number().over(order)).withColumn("runs", failed_before == 0)


def first_creates(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each request with ``created``: the first of its keys wins, the others repeat it."""
    return requests.withColumn("created", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def batch_outcomes(requests: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Repeated ids repeat the outcome: deleted, or the code of a missing instance."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, key, "left").withColumn("outcome", F.when(F.col("_known"), "deleted").otherwise("10400")).drop("_known")


def _granted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted claims with ``granted``: only a claim that was granted changes who holds the lease, and until when."""
    instance, holder, held_until = None, None, None
    for batch in batches:
        out = []
        for key, owner, at, until in zip(*[batch.column(c).to_pylist() for c in ("instance_id", "owner", "claimed_at", "until")], strict=True):
            if key != instance:
                instance, holder, held_until = key, None, None
            free = held_until is None or held_until <= at or holder == owner
            if free:
                holder, held_until = owner, until
            out.append(free)
        yield batch.append_column("granted", pa.array(out, pa.bool_()))


def lease_outcomes(claims: DataFrame) -> DataFrame:
    """Each claim with ``granted``: the instance has no lease, the claimer's own, or one that is over by then.

    claims: instance_id, claim_id, owner, claimed_at, until. The claims of an instance stream by in order, so one with many needs no more memory.
    """
    rows = claims.repartition("instance_id").sortWithinPartitions("instance_id", "claimed_at", "claim_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema.fields)
    return rows.mapInArrow(_granted, f"{fields}, granted boolean")


def controlled(status: Column, action: Column) -> Column:
    """The status after a control; null where the control is an error."""
    ended = status.isin(*K.TERMINAL)
    return (
        F.when((action == "pause") & (ended | (status == "paused")), F.lit(None)).when((action == "pause") & (status == "running"), "waitingForPause").when(action == "pause", "paused")
        .when((action == "resume") & status.isin("paused", "waitingForPause"), "queued").when(action == "resume", status)
        .when((action == "terminate") & ended, F.lit(None)).when(action == "terminate", "terminated").when(action == "restart", "queued")
    )


def reassembled(chunks: DataFrame) -> DataFrame:
    """stream_id, chunks, text: the chunks in order up to the first gap in ``seq``, which counts from 0."""
    ordered = W.partitionBy("stream_id").orderBy("seq")
    kept = chunks.withColumn("_place", F.row_number().over(ordered) - 1).where("seq = _place")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return kept.groupBy("stream_id").agg(F.count("*").alias("chunks"), F.concat_ws("", F.transform(parts, lambda x: x["text"])).alias("text"))


def next_buffered(inbox: DataFrame) -> DataFrame:
    """instance_id, type, event_id: the oldest event of each type that nothing has taken."""
    return inbox.where(F.col("consumed_at").isNull()).groupBy("instance_id", "type").agg(F.min("id").alias("event_id"))


def by_public_id(instances: DataFrame, public_id: str) -> DataFrame:
    """public id, matches, first_id, ambiguous: the oldest instance of each public id, and whether there are others."""
    out = instances.groupBy(public_id).agg(F.count("*").alias("matches"), F.min_by("id", F.struct("created_at", "id")).alias("first_id"))
    return out.withColumn("ambiguous", F.col("matches") > 1)


def last_steps(steps: DataFrame, kinds: tuple[str, ...] = ("do", "waitForEvent")) -> DataFrame:
    """instance_id, name, ordinal, type, state: the last started step of each name among ``kinds``."""
    last = F.max(F.struct("ordinal", "type", "state")).alias("s")
    return steps.where(F.col("type").isin(*kinds)).groupBy("instance_id", "name").agg(last).select("instance_id", "name", "s.*")


def fenced(commits: DataFrame, instances: DataFrame) -> DataFrame:
    """Each commit with ``outcome``: it counts only under a lease of its owner that is not over; the deadline itself is over, and a lease without one holds."""
    lease = instances.select(F.col("id").alias("instance_id"), "lease_owner", "lease_expires_at", F.lit(True).alias("_there"))
    held = F.coalesce((F.col("lease_owner") == F.col("owner")) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > F.col("created_at"))), F.lit(False))
    outcome = F.when(F.col("_there").isNull(), "no-instance").when(held, "committed").otherwise("lease-lost")
    return commits.join(lease, "instance_id", "left").withColumn("outcome", outcome).drop("_there")


def combined(branches: DataFrame) -> DataFrame:
    """instance_id, type, all_done, any_done, first_done: parallel steps joined by all, any and first."""
    done = F.col("state") == "completed"
    return branches.groupBy("instance_id", "type").agg(F.bool_and(done).alias("all_done"), F.bool_or(done).alias("any_done"), F.min(F.when(done, F.col("ordinal"))).alias("first_done"))


def attempt_ends(attempts: DataFrame, timeout_ms: int) -> DataFrame:
    """Each attempt with ``ended``: open without a successor, timed-out once it takes longer than ``timeout_ms``, else finished."""
    took = F.lead("created_at").over(W.partitionBy("instance_id").orderBy("ordinal")) - F.col("created_at")
    return attempts.withColumn("ended", F.when(took.isNull(), "open").when(took > timeout_ms, "timed-out").otherwise("finished"))


def valid_instance_id(public_id: Column) -> Column:
    """1 to 100 characters, and none of the ids that schedules make."""
    return F.coalesce(F.length(public_id).between(1, 100) & ~public_id.rlike(r"\Acf_[0-9a-f]{64}\z"), F.lit(False))


def valid_batch_id(public_id: Column) -> Column:
    """An id of a batch request: letters, digits, ``_`` and, after the first, ``-``; no reserved word, and none that schedules make."""
    return valid_instance_id(public_id) & public_id.rlike(r"\A[a-zA-Z0-9_][a-zA-Z0-9_-]*\z") & ~public_id.isin(*K.RESERVED_IDS)


def batch_created(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Each request (batch, index, public_id) with ``outcome``: created, 10415 for an id met before in the batch, 10405 for an instance
    that is there, or refused, with all others of its batch, if the batch is too large or has a wrong id. A request without an id is created.

    Only batches of the allowed size are put in order, so no key is long.
    """
    right = F.col("public_id").isNull() | valid_batch_id(F.col("public_id"))
    batches = requests.groupBy("batch").agg((F.bool_and(right) & (F.count("*") <= K.BATCH_MOST)).alias("_accepted"))
    rows = requests.join(batches, "batch")
    again = F.row_number().over(W.partitionBy("batch", "public_id").orderBy("index")) > 1
    known = existing.select("public_id").distinct().withColumn("_known", F.lit(True))
    taken = rows.where("_accepted").withColumn("_again", again).join(known, "public_id", "left")
    outcome = F.when(F.col("public_id").isNull(), "created").when(F.col("_again"), "10415").when(F.col("_known"), "10405").otherwise("created")
    out = taken.withColumn("outcome", outcome).drop("_accepted", "_again", "_known")
    return out.unionByName(rows.where("not _accepted").drop("_accepted").withColumn("outcome", F.lit("refused")))


def with_retention(instances: DataFrame, workflows: DataFrame, plans: DataFrame) -> DataFrame:
    """``instances`` with success_ms and error_ms: each from the instance itself, else its workflow, else its plan; null keeps them for ever.

    instances: workflow, plan, own_success_ms, own_error_ms. workflows and plans have one row for each name, with success_ms and error_ms.
    """
    level = lambda df, key: df.select(key, F.col("success_ms").alias(f"_{key}_success"), F.col("error_ms").alias(f"_{key}_error"))
    out = instances.join(level(workflows, "workflow"), "workflow", "left").join(level(plans, "plan"), "plan", "left")
    for end in ("success", "error"):
        out = out.withColumn(f"{end}_ms", F.coalesce(f"own_{end}_ms", f"_workflow_{end}", f"_plan_{end}"))
    return out.drop("_workflow_success", "_workflow_error", "_plan_success", "_plan_error")


def event_outcome(status: Column, event_type: Column) -> Column:
    """Whether an event may be sent: first whether there is an instance, then whether it takes events, then the type's letters."""
    bad = ~F.coalesce(event_type.rlike(r"\A[A-Za-z0-9_-]{1,100}\z"), F.lit(False))
    return F.when(status.isNull(), "not-found").when(~K.can_execute(status), "not-running").when(bad, "bad-type").otherwise("sent")


def finished_rollbacks(registrations: DataFrame) -> DataFrame:
    """instance_id, outcome, status: failed and errored if any compensation failed, else complete and terminated."""
    failed = F.bool_or("failed")
    return registrations.groupBy("instance_id").agg(F.when(failed, "failed").otherwise("complete").alias("outcome"), F.when(failed, "errored").otherwise("terminated").alias("status"))
