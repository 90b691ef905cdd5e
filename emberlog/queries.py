"""The registered queries over the journal views, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import kernel as K
from emberlog.operators import coverage, documents, inventory, journal, schedule, traces
from emberlog.plans import adapt as A
from emberlog.sources.shared import written
from emberlog.streaming import machine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: 1998-01-01, inside the dates of orders.
NOW = 883_612_800_000
CRON_RULES = ["30 5 * * *", "*/20 8-17 * * MON-FRI", "0 0 1 JAN,JUL *", "15 12 13 * FRI"]
CRON_NOW = "1998-01-13 13:00:00"

# The journal views as common table expressions.
INSTANCES = """
instances as (
  select o_orderkey id, o_orderpriority workflow,
    case o_orderstatus when 'F' then 'queued' when 'O' then 'waiting' else 'rollingBack' end status,
    epoch_us(o_orderdate) // 1000 created_at,
    case o_custkey % 3 when 1 then 'exec-a' when 2 then 'exec-b' end lease_owner,
    case when o_custkey % 3 <> 0 then epoch_us(o_orderdate) // 1000 + (o_orderkey % 400) * 86400000 end lease_expires_at
  from orders)"""
STEPS = """
steps as (
  select l_orderkey instance_id, case l_returnflag when 'R' then 'do' when 'A' then 'sleep' else 'waitForEvent' end type,
    l_linestatus name, case when l_quantity <= 10 then 'failed' when l_quantity <= 20 then 'waiting_retry' else 'completed' end state,
    epoch_us(l_shipdate) // 1000 created_at,
    row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) ordinal,
    row_number() over (partition by l_orderkey, l_returnflag, l_linestatus order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) count
  from lineitem)"""
LOG = """
log as (
  select event_id id, user_id instance_id,
    case event_type when 'view' then 'step.started' when 'click' then 'attempt.started' when 'purchase' then 'step.completed'
      when 'error' then 'attempt.errored' else 'workflow.completed' end kind,
    props detail, value, epoch_us(ts) // 1000 created_at
  from events)"""
ITEMS = """
items as (select p_partkey id, p_type kind, p_brand container, sha256(p_name || '|' || p_brand || '|' || p_type || '|' || p_size) fingerprint from part),
baseline as (
  select id, kind, container, case when id % 11 = 0 then 'old' else fingerprint end fingerprint from items where id % 7 <> 0
  union all select id + 100000000, kind, container, fingerprint from items where id % 13 = 0)"""
VERDICTS = """
verdicts as (
  select d.doc_id probe, lang profile, lang || '.' || source || '.' || (d.doc_id % 10) requirement,
    case when quality is null then 'UNTESTED' when quality = 0 and d.doc_id % 5 = 0 then 'BLOCKED' when toxic = 1 then 'DIVERGENT'
      when d.doc_id % 17 = 0 then 'STALE' when d.doc_id % 19 = 0 then 'UNSUPPORTED' else 'VERIFIED' end verdict
  from documents d left join labels l on d.doc_id = l.doc_id)"""
RANK = "case verdict when 'DIVERGENT' then 0 when 'BLOCKED' then 1 when 'STALE' then 2 when 'UNTESTED' then 3 when 'VERIFIED' then 4 end"
UNRANK = "case {} when 0 then 'DIVERGENT' when 1 then 'BLOCKED' when 2 then 'STALE' when 3 then 'UNTESTED' when 4 then 'VERIFIED' end"
ITEM_STATES = f"""
item_states as (
  select i.id, i.kind, i.container, case when n is null then 'UNMAPPED' when r is null then 'UNSUPPORTED' else {UNRANK.format("r")} end state
  from items i left join (select probe % 3000 id, count(*) n, min({RANK}) r from verdicts group by 1) v on i.id = v.id)"""
CELLS = ", ".join(f"cast(count(*) filter (state = '{s}') as bigint) {s.lower()}" for s in coverage.STATES)
PCT = "case when {1} > 0 then floor(cast({0} as double) / cast({1} as double) * 1000.0 + 0.5) / 10.0 end"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""with {INSTANCES}, {STEPS},
registered as (select instance_id, max(case when state in ('failed', 'waiting_retry') then 1 else 0 end) act from steps where type = 'do' group by 1)
select id, workflow, status, created_at from instances
where (lease_owner is null or lease_owner = 'exec-a' or lease_expires_at <= {NOW}) and (status = 'queued'
  or status = 'waiting' and id in (select instance_id from steps where type <> 'do' and created_at <= {NOW})
  or status = 'rollingBack' and coalesce((select act from registered where instance_id = id), 1) = 1)""")
def runnable_instances(spark: SparkSession, d: str) -> DataFrame:
    steps = A.steps(spark, d)
    timers = steps.where("type <> 'do'").select("instance_id", F.col("created_at").alias("wake_at"))
    registered = steps.where("type = 'do'").select("instance_id", F.col("state").isin("failed", "waiting_retry").alias("actionable"))
    return journal.runnable(A.instances(spark, d), timers, registered, NOW, "exec-a").select("id", "workflow", "status", "created_at")


@query(f"with {STEPS} select instance_id, type, name, ordinal, count, instance_id || '/' || type || '/' || name || '/' || count step_key from steps")
def step_identity_ordinals(spark: SparkSession, d: str) -> DataFrame:
    key = K.step_key(F.col("instance_id"), F.col("type"), F.col("name"), F.col("count"))
    return A.numbered_steps(A.steps(spark, d)).select("instance_id", "type", "name", F.col("ordinal").cast("long").alias("ordinal"), F.col("count").cast("long").alias("count"), key.alias("step_key"))


@query(f"""with a as (select l_orderkey instance_id, l_linenumber attempt, cast(l_quantity as bigint) * 1000 base,
  case l_returnflag when 'R' then 'exponential' when 'A' then 'linear' else 'constant' end backoff from lineitem)
select instance_id, attempt, backoff, base, attempt > {K.RETRY_LIMIT} is_final,
  cast(case backoff when 'linear' then base * attempt when 'exponential' then base * pow(2, attempt - 1) else base end as bigint) delay_ms from a""")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    backoff = A.choice(F.col("l_returnflag"), {"R": "exponential", "A": "linear", "N": "constant"})
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity").cast("long") * 1000).alias("base"), backoff.alias("backoff"))
    final = K.is_terminal_failure(F.col("attempt"), F.lit(K.RETRY_LIMIT), F.lit(False))
    return rows.select("instance_id", "attempt", "backoff", "base", final.alias("is_final"), K.retry_delay_ms(F.col("base"), F.col("attempt"), F.col("backoff")).alias("delay_ms"))


@query(f"""with {STEPS} select instance_id, type, name, count(*) attempts, count(*) filter (state = 'failed') failures,
  max_by(state, ordinal) last_state, string_agg(state, ',' order by ordinal) states from steps group by 1, 2, 3""")
def attempt_history(spark: SparkSession, d: str) -> DataFrame:
    return journal.attempt_summary(A.numbered_steps(A.steps(spark, d)))


@query(f"""with {LOG} select instance_id, max(id) last_id, max(created_at) updated_at,
  case max_by(kind, id) when 'workflow.completed' then 'complete' when 'attempt.errored' then 'waiting' else 'running' end status from log group by 1""")
def latest_instance_status(spark: SparkSession, d: str) -> DataFrame:
    return journal.latest_status(A.log(spark, d))


@query(f"""with {LOG} select instance_id, id, previous, kind from (select *, lag(kind) over (partition by instance_id order by id) previous from log)
where previous is null or previous <> kind""")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    return journal.status_changes(A.log(spark, d))


@query(f"""with {INSTANCES}, e as (select id, case status when 'queued' then created_at + 7 * 86400000 when 'rollingBack' then created_at + 2592000000 end expires_at from instances),
doomed as (select id from e where expires_at <= {NOW})
select l_orderkey instance_id, count(*) steps_left from lineitem where l_orderkey not in (select id from doomed) group by 1""")
def retention_expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = A.instances(spark, d)
    ended = A.choice(F.col("status"), {"queued": "complete", "rollingBack": "errored", "waiting": "waiting"})
    rows = rows.withColumn("expires_at", journal.expires_at(ended, F.col("created_at"), F.lit(7 * A.DAY_MS), F.lit(30 * A.DAY_MS)))
    return journal.without(A.steps(spark, d), journal.expired(rows, NOW)).groupBy("instance_id").agg(F.count("*").alias("steps_left"))


@query(f"""with {INSTANCES} select workflow, id, status, position, total from (
  select *, row_number() over (partition by workflow order by created_at, id) position, count(*) over (partition by workflow) total from instances where status = 'waiting')
where position > 20 and position <= 45""")
def list_instances_page(spark: SparkSession, d: str) -> DataFrame:
    rows = journal.page(A.instances(spark, d).where("status = 'waiting'"), "workflow", ["created_at", "id"], 20, 25)
    return rows.select("workflow", "id", "status", F.col("position").cast("long").alias("position"), "total")


FEED = f"""with {LOG}, t as (select instance_id, min(id) terminal_id from log where kind = 'workflow.completed' group by 1),
rows as (select log.* from log left join t using (instance_id) where (terminal_id is null or id <= terminal_id) and id > 100 {{}})
select instance_id, id, kind, position from (select *, row_number() over (partition by instance_id order by id) position from rows) where position <= 100"""


@query(FEED.format(""))
def event_feed_page(spark: SparkSession, d: str) -> DataFrame:
    return journal.feed(A.log(spark, d), 100, 100).select("instance_id", "id", "kind", F.col("position").cast("long").alias("position"))


@query(FEED.format("and kind in ('step.completed', 'attempt.errored')"))
def event_feed_filtered(spark: SparkSession, d: str) -> DataFrame:
    return journal.feed(A.log(spark, d), 100, 100, ("step.completed", "attempt.errored")).select("instance_id", "id", "kind", F.col("position").cast("long").alias("position"))


@query(f"with {LOG} select id, kind, case when kind = 'step.completed' then '[REDACTED]' else detail end output from log")
def redacted_feed(spark: SparkSession, d: str) -> DataFrame:
    return journal.redacted(A.log(spark, d), F.col("kind") == "step.completed").select("id", "kind", "output")


@query(f"""with {LOG}, w as (select instance_id, id wait_id, row_number() over (partition by instance_id order by id) k from log where kind = 'step.started'),
e as (select instance_id, id event_id, row_number() over (partition by instance_id order by id) k from log where kind = 'step.completed')
select instance_id, wait_id, event_id, event_id < wait_id buffered from w left join e using (instance_id, k)""")
def event_wait_pairing(spark: SparkSession, d: str) -> DataFrame:
    log = A.log(spark, d)
    waits = log.where("kind = 'step.started'").select("instance_id", F.col("id").alias("wait_id"))
    events = log.where("kind = 'step.completed'").select("instance_id", F.col("id").alias("event_id"))
    return journal.pair_waits(waits, events, ["instance_id"]).select("instance_id", "wait_id", "event_id", (F.col("event_id") < F.col("wait_id")).alias("buffered"))


@query(f"""with {STEPS}, t as (select instance_id, min(ordinal) target from steps where state = 'failed' group by 1)
select instance_id, ordinal, state from steps left join t using (instance_id) where target is null or ordinal < target""")
def restart_survivors(spark: SparkSession, d: str) -> DataFrame:
    steps = A.numbered_steps(A.steps(spark, d)).withColumn("ordinal", F.col("ordinal").cast("long"))
    targets = steps.where("state = 'failed'").groupBy("instance_id").agg(F.min("ordinal").alias("ordinal"))
    return journal.restart_survivors(steps, targets).select("instance_id", "ordinal", "state")


@query(f"""with {STEPS} select instance_id, ordinal, row_number() over (partition by instance_id order by ordinal desc) position,
  coalesce(max(case when state = 'failed' then 1 else 0 end) over (partition by instance_id order by ordinal desc rows between unbounded preceding and 1 preceding), 0) = 0 runs
from steps where type = 'do'""")
def rollback_order(spark: SparkSession, d: str) -> DataFrame:
    rows = A.numbered_steps(A.steps(spark, d)).where("type = 'do'").withColumn("failed", F.col("state") == "failed")
    return journal.rollback_plan(rows).select("instance_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("position").cast("long").alias("position"), "runs")


@query("""select event_id, user_id % 40 || '-' || event_type public_id,
  row_number() over (partition by user_id % 40, event_type order by event_id) = 1 created from events""")
def duplicate_creates(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "events").select("event_id", F.concat_ws("-", (F.col("user_id") % 40).cast("string"), "event_type").alias("public_id"))
    return journal.first_creates(rows, ["public_id"], ["event_id"])


@query("""select event_id, user_id * 3 id, case when user_id * 3 in (select o_orderkey from orders) then 'deleted' else '10400' end outcome from events""")
def delete_batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    requests = A.table(spark, d, "events").select("event_id", (F.col("user_id") * 3).alias("id"))
    return journal.batch_outcomes(requests, A.instances(spark, d), "id")


@query("""with recursive c as (select *, row_number() over (partition by instance_id order by claimed_at, claim_id) k from (
  select event_id claim_id, user_id % 50 instance_id, case when value > 50 then 'exec-a' else 'exec-b' end owner, epoch_us(ts) // 1000 claimed_at,
    epoch_us(ts) // 1000 + event_id % 4 * 28800000 until from events)),
f as (select instance_id, k, claim_id, owner, true granted, owner holder, until held_until from c where k = 1
  union all select c.instance_id, c.k, c.claim_id, c.owner, held_until <= claimed_at or holder = c.owner,
    case when held_until <= claimed_at or holder = c.owner then c.owner else holder end, case when held_until <= claimed_at or holder = c.owner then until else held_until end
  from f join c on c.instance_id = f.instance_id and c.k = f.k + 1)
select claim_id, owner, granted from f""")
def lease_claims(spark: SparkSession, d: str) -> DataFrame:
    at = K.epoch_ms(F.col("ts"))
    rows = A.table(spark, d, "events").select(
        F.col("event_id").alias("claim_id"), (F.col("user_id") % 50).alias("instance_id"), F.when(F.col("value") > 50, "exec-a").otherwise("exec-b").alias("owner"), at.alias("claimed_at"), (at + F.col("event_id") % 4 * 28_800_000).alias("until")
    )
    return journal.lease_outcomes(rows).select("claim_id", "owner", "granted")


@query(f"""with {INSTANCES}, a as (select id, case status when 'queued' then 'running' when 'waiting' then 'paused' else 'complete' end status, case id % 4 when 0 then 'pause' when 1 then 'resume' when 2 then 'terminate' else 'restart' end action from instances)
select id, status, action, case when action = 'pause' and status in ('complete', 'paused') then null when action = 'pause' and status = 'running' then 'waitingForPause'
  when action = 'resume' and status = 'paused' then 'queued' when action = 'resume' then status when action = 'terminate' and status = 'complete' then null when action = 'terminate' then 'terminated' else 'queued' end after from a""")
def control_transitions(spark: SparkSession, d: str) -> DataFrame:
    status = A.choice(F.col("status"), {"queued": "running", "waiting": "paused", "rollingBack": "complete"})
    action = A.choice(F.col("id") % 4, {0: "pause", 1: "resume", 2: "terminate", 3: "restart"})
    rows = A.instances(spark, d).select("id", status.alias("status"), action.alias("action"))
    return rows.withColumn("after", journal.controlled(F.col("status"), F.col("action")))


CRON_SQL = f"""with s as (select distinct o_orderpriority workflow, cron, timestamp '1998-01-07 22:41:30' cursor from orders,
  (values {", ".join(f"('{x}')" for x in CRON_RULES)}) r(cron)),
m as (select workflow, cron, unnest(generate_series(date_trunc('minute', cursor) + interval 1 minute, timestamp '{CRON_NOW}', interval 1 minute)) t from s),
f as (select workflow, cron, t, epoch_ms(t) scheduled_time from m where
  cron = '{CRON_RULES[0]}' and minute(t) = 30 and hour(t) = 5
  or cron = '{CRON_RULES[1]}' and minute(t) in (0, 20, 40) and hour(t) between 8 and 17 and dayofweek(t) between 1 and 5
  or cron = '{CRON_RULES[2]}' and minute(t) = 0 and hour(t) = 0 and day(t) = 1 and month(t) in (1, 7)
  or cron = '{CRON_RULES[3]}' and minute(t) = 15 and hour(t) = 12 and (day(t) = 13 or dayofweek(t) = 5))"""


def fired(spark: SparkSession, d: str) -> DataFrame:
    rules = F.explode(F.array(*[F.lit(x) for x in CRON_RULES]))
    rows = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("workflow")).distinct().withColumn("cron", rules)
    return schedule.firings(rows.withColumn("cursor", F.lit("1998-01-07 22:41:30").cast("timestamp")), CRON_RULES, CRON_NOW)


@query(f"{CRON_SQL} select workflow, cron, scheduled_time from f")
def cron_firings(spark: SparkSession, d: str) -> DataFrame:
    return fired(spark, d)


@query(f"{CRON_SQL} select workflow, cron, scheduled_time, 'cf_' || sha256(workflow || chr(0) || cron || chr(0) || scheduled_time) instance_id from f where (scheduled_time // 60000) % 3 <> 0")
def scheduled_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = fired(spark, d)
    return schedule.claims(rows, rows.where("(scheduled_time div 60000) % 3 = 0"))


@query(f"""with {LOG} select instance_id, count(*) events, coalesce(string_agg(kind, ',' order by id) filter (kind in ('step.started', 'workflow.completed')), '') lifecycle,
  count(*) filter (kind = 'attempt.started') attempts, count(*) filter (kind = 'attempt.errored') errors, max_by(detail, id) last_detail from log group by 1""")
def trace_normalized(spark: SparkSession, d: str) -> DataFrame:
    return traces.normalized(A.log(spark, d))


@query(f"""with {LOG}, e as (select * from log where id % 10 <> 3), a as (select id, case when id % 7 = 0 then 'other' else kind end kind, value * 1.02 + case when id % 5 = 0 then 100 else 0 end value from log where id % 10 <> 4)
select coalesce(e.id, a.id) id, case when e.id is null then 'missing-expected' when a.id is null then 'missing-actual' when e.kind is not distinct from a.kind and abs(e.value - a.value) <= 100.0 then 'equal' else 'different' end outcome
from e full join a on e.id = a.id""")
def trace_diff(spark: SparkSession, d: str) -> DataFrame:
    log = A.log(spark, d).select("id", "kind", "value")
    actual = log.where("id % 10 <> 4").select(
        "id", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("kind")).alias("kind"), (F.col("value") * 1.02 + F.when(F.col("id") % 5 == 0, 100).otherwise(0)).alias("value")
    )
    return traces.differences(log.where("id % 10 <> 3"), actual, "id", ["kind"], "value", 100.0)


@query(f"with {LOG} select kind, json_extract_string(detail, '$.k') step, count(*) n from log group by 1, 2")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return traces.event_counts(A.log(spark, d))


@query(f"with {VERDICTS} select probe, profile, requirement, verdict from verdicts")
def probe_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return A.verdicts(spark, d)


STATES_SQL = f"""{VERDICTS}, states as (select profile, requirement, coalesce({UNRANK.format(f"min({RANK})")}, 'UNTESTED') state from verdicts group by 1, 2)"""


def requirement_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = A.verdicts(spark, d)
    keys = ["profile", "requirement"]
    return coverage.requirement_states(rows.select(*keys).distinct(), rows, keys)


@query(f"with {STATES_SQL} select * from states")
def requirement_states(spark: SparkSession, d: str) -> DataFrame:
    return requirement_rows(spark, d)


@query(f"with {STATES_SQL} select profile, {CELLS}, count(*) denominator, {PCT.format('verified', 'denominator')} verified_pct from states group by 1")
def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    return coverage.cells(requirement_rows(spark, d), "profile")


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    links = A.verdicts(spark, d).select((F.col("probe") % 3000).alias("id"), "verdict")
    return coverage.item_states(A.items(spark, d), links, "id").select("id", "kind", "container", "state")


@query(f"""with {ITEMS}, {VERDICTS}, {ITEM_STATES},
r as (select case when grouping(kind) = 0 then 'kind' when grouping(container) = 0 then 'container' else 'overall' end grouping_, coalesce(kind, container, '') value,
  count(*) total, count(*) filter (state <> 'UNMAPPED') mapped, count(*) filter (state = 'VERIFIED') verified from item_states group by grouping sets ((), (kind), (container)))
select grouping_ as "grouping", value, total, mapped, verified, {PCT.format("mapped", "total")} mapped_pct, {PCT.format("verified", "total")} verified_pct from r""")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return coverage.rollup(item_rows(spark, d), ["kind", "container"])


GATE_SQL = f"""{STATES_SQL}, a as (select profile, requirement id, state from states where not (profile = 'en' and requirement like '%.3') union all select 'de', 'de.new', 'VERIFIED'),
b as (select profile, requirement id, case state when 'STALE' then 'VERIFIED' else state end state from states union all select 'de', 'de.gone', 'UNTESTED' union all select 'xx', 'xx.' || x, 'VERIFIED' from range(2) r(x)),
shrunk as (select 'denominator-shrink' kind, '*' oracle, profile, 'denominator' metric, (select coalesce(string_agg(id, ',' order by id), '') from b l where l.profile = p.profile and not exists (select 1 from a where a.profile = l.profile and a.id = l.id)) as scope,
    (select count(*) from b l where l.profile = p.profile) n, (select count(*) from a l where l.profile = p.profile) m from (select distinct profile from b) p),
dropped as (select 'metric-drop' kind, 'local' oracle, profile, 'verified-numerator' metric, (select coalesce(string_agg(id, ',' order by id), '') from b l where l.profile = p.profile and state = 'VERIFIED'
      and not exists (select 1 from a where a.profile = l.profile and a.id = l.id and a.state = 'VERIFIED')) as scope,
    (select count(*) from b l where l.profile = p.profile and state = 'VERIFIED') n, (select count(*) from a l where l.profile = p.profile and state = 'VERIFIED') m from (select distinct profile from b where profile in (select profile from a)) p),
found as (select kind, oracle, profile, metric, scope, cast(n as varchar) before_, cast(m as varchar) after_ from (select * from shrunk union all select * from dropped) where scope <> '' or m < n
  union all select 'upstream-pin-update', 'local', '*', 'candidate', '*', 'one', 'two')"""


def gate(spark: SparkSession, d: str) -> DataFrame:
    states = requirement_rows(spark, d).select("profile", F.lit("local").alias("oracle"), F.col("requirement").alias("id"), "state")
    more = lambda rows: spark.createDataFrame(rows, "profile string, oracle string, id string, state string")
    after = states.where(~((F.col("profile") == "en") & F.col("id").endswith(".3"))).unionByName(more([("de", "local", "de.new", "VERIFIED")]))
    before = states.withColumn("state", F.when(F.col("state") == "STALE", "VERIFIED").otherwise(F.col("state")))
    before = before.unionByName(more([("de", "local", "de.gone", "UNTESTED"), ("xx", "local", "xx.0", "VERIFIED"), ("xx", "local", "xx.1", "VERIFIED")]))
    pins = [spark.createDataFrame([("local", x), (y, x)], "oracle string, candidate string") for x, y in (("one", "old"), ("two", "new"))]
    return coverage.regressions(before, after).unionByName(coverage.pin_updates(*pins))


@query(f'with {GATE_SQL} select kind, oracle, profile, metric, scope, before_ as "before", after_ as "after" from found')
def gate_regressions(spark: SparkSession, d: str) -> DataFrame:
    return gate(spark, d)


@query(f"""with {GATE_SQL}, w as (select * from found where profile = 'xx' union all select * from found where profile = 'xx' union all select * from found where kind = 'upstream-pin-update'
  union all select kind, oracle, profile, metric, scope, before_ || '0', after_ from found where profile = 'de')
select kind, oracle, profile, metric, scope, before_ as "before", after_ as "after", case when profile = 'xx' or kind = 'upstream-pin-update' then 'waived' else 'unwaived' end outcome from found
union all select *, 'unused-waiver' from found where profile = 'xx' union all select kind, oracle, profile, metric, scope, before_ || '0', after_, 'unused-waiver' from found where profile = 'de'""")
def waiver_matching(spark: SparkSession, d: str) -> DataFrame:
    found = gate(spark, d)
    gone, wrong = found.where("profile = 'xx'"), found.where("profile = 'de'").withColumn("before", F.concat("before", F.lit("0")))
    return coverage.matched_waivers(found, gone.unionByName(gone).unionByName(found.where("kind = 'upstream-pin-update'")).unionByName(wrong))


@query(f"""with {ITEMS}, {VERDICTS}, {ITEM_STATES}, u as (select container, id, count(*) over (partition by container) size, row_number() over (partition by container order by id) position from item_states where state = 'UNMAPPED')
select container, id, size, greatest(size - 15, 0) remainder from u where position <= 15""")
def unmapped_topk(spark: SparkSession, d: str) -> DataFrame:
    return coverage.unmapped_top(item_rows(spark, d)).select("container", "id", "size", "remainder")


@query(f"""with {ITEMS} select coalesce(b.id, i.id) id, case when b.id is null then 'added' when i.id is null then 'removed' else 'changed' end change
from baseline b full join items i on b.id = i.id where b.fingerprint is distinct from i.fingerprint""")
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    return inventory.difference(A.baseline(items), items, "id", ["fingerprint"])


@query(f"""with {ITEMS} select coalesce(b.id, i.id) id, coalesce(i.fingerprint, b.fingerprint) fingerprint, case when b.id is null then 'run-2' else 'run-1' end first_seen,
  case when i.id is null then 'run-1' else 'run-2' end last_seen, i.id is null removed from baseline b full join items i on b.id = i.id""")
def baseline_merge(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    old = A.baseline(items).select("id", "fingerprint", F.lit("run-1").alias("first_seen"), F.lit("run-1").alias("last_seen"), F.lit(False).alias("removed"))
    return inventory.merge_baseline(old, items.select("id", "fingerprint"), "id", "run-2")


@query("""with recursive edges as (select p_partkey source, p_partkey * 2 target from part where p_partkey > 0 union all select p_partkey, p_partkey * 3 from part where p_partkey > 0 and p_size % 2 = 0),
walk as (select p_partkey node, 0 depth, cast(null as bigint) via from part where p_partkey between 1 and 5 union all
  select target, depth + 1, source from walk join edges on source = node where depth < 40),
least as (select node, min(depth) depth from walk group by 1)
select node, depth, min(via) via from walk join least using (node, depth) group by 1, 2""")
def reference_closure(spark: SparkSession, d: str) -> DataFrame:
    part = A.table(spark, d, "part").where("p_partkey > 0")
    edges = part.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target"))
    edges = edges.unionByName(part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 3).alias("target")))
    return inventory.closure(part.where("p_partkey <= 5").select(F.col("p_partkey").alias("node")), edges, written)


@query("""select p_partkey id, lower(lpad(hex(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split(p_name, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) identity from part""")
def fnv_identity(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), K.fnv1a(F.col("p_name")).alias("identity"))


@query("""select user_id, event_id, case when here and not before then 'new' when here and last then 'open' when here then 'recurred' when before then 'resolved' end state from (
  select user_id, event_id, value > 30 here, coalesce(max(case when value > 30 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) = 1 before,
    coalesce(lag(value > 30) over (partition by user_id order by event_id), false) last from events)""")
def drift_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 30).alias("here"))
    return inventory.drift_lifecycle(rows, "user_id", "event_id", "here").select("user_id", "event_id", "state")


@query("""select p_partkey id, p_size || '.' || p_partkey % 10 || '.0' version, p_size > 9 or (p_size = 9 and p_partkey % 10 >= 2) included from part""")
def version_gate(spark: SparkSession, d: str) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("0"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), version.alias("version"), inventory.version_at_least(version, F.lit("9.2.0")).alias("included"))


@query("""select p_partkey id, (p_size || case p_partkey % 8 when 0 then ' seconds' when 1 then ' hour' when 2 then '' when 3 then ' moons' when 4 then ' s' when 5 then ' Minutes' when 6 then 's' else 'WEEK ' end) "text",
  cast(case p_partkey % 8 when 0 then p_size * 1000 when 1 then p_size * 3600000 when 2 then p_size when 5 then p_size * 60000 when 7 then cast(p_size as bigint) * 604800000 end as bigint) ms from part""")
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    unit = A.choice(F.col("p_partkey") % 8, {0: " seconds", 1: " hour", 2: "", 3: " moons", 4: " s", 5: " Minutes", 6: "s", 7: "WEEK "})
    text = F.concat(F.col("p_size").cast("string"), unit)
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), K.duration_ms(text).alias("ms"))


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return documents.sections(A.table(spark, d, "pages"))


@query()
def section_diff(spark: SparkSession, d: str) -> DataFrame:
    pages = A.table(spark, d, "pages")
    edited = F.when(F.col("page_id") % 9 == 0, F.regexp_replace("html", r"(?i)</p>", " edited</p>")).otherwise(F.col("html"))
    return documents.section_changes(documents.sections(pages), documents.sections(pages.where("page_id % 11 <> 0").withColumn("html", edited)))


@query(f"""with k as (select p_brand || '/' || p_partkey as "key", case when p_size % 5 <> 0 then p_size * 40000000000 end expires_at from part)
select "key" from k where starts_with("key", 'Brand#1') and "key" > 'Brand#12' and (expires_at is null or expires_at > {NOW}) order by 1 limit 100""")
def kv_prefix_page(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select(
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * F.lit(40_000_000_000)).alias("expires_at")
    )
    return inventory.prefix_page(rows, "Brand#1", "Brand#12", 100, NOW).select("key")


@query("""with k as (select case when p_size % 3 = 0 then p_type else p_brand || '/' || p_name end "key" from part)
select case when contains("key", '/') then split_part("key", '/', 1) || '/' else "key" end prefix, count(*) objects from k group by 1""")
def object_delimiter(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat_ws("/", "p_brand", "p_name"))
    return inventory.delimited(A.table(spark, d, "part").select(key.alias("key")), "/")


@query("""with c as (select conv_id stream_id, turn seq, text from conversations where not (conv_id % 5 = 0 and turn = 2)), p as (select *, row_number() over (partition by stream_id order by seq) - 1 place from c)
select stream_id, count(*) chunks, string_agg(text, '' order by seq) "text" from p where seq = place group by 1""")
def stream_reassembly(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "conversations").where("not (conv_id % 5 = 0 and turn = 2)")
    return journal.reassembled(rows.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), "text"))


@query()
def stateful_fold(spark: SparkSession, d: str) -> DataFrame:
    return machine.fold(A.log(spark, d).select("instance_id", "id", "kind"))
