"""Registered queries over public events, the traces they make, and what write commands leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import kernel as K
from emberlog.operators import events, writes
from emberlog.plans import adapt as A
from emberlog.queries import INSTANCES, query

#: All public kinds and three that are written but not public.
KINDS = [*events.PUBLIC_TYPES, "instance.scheduled", "instance.restarted", "instance.queued"]
TYPES, COMMANDS = ["do", "sleep", "waitForEvent"], ["ensure", "complete", "fail", "fail_output", "retry", "timer_done", "timed_out"]
ERRORS = str(tuple(events.NO_MESSAGE))

FULL_LOG = f"""
full_log as (select event_id id, user_id instance_id, ({KINDS})[event_id % {len(KINDS)} + 1] kind, epoch_us(ts) // 1000 created_at,
  case event_id % 7 when 0 then null when 1 then '{{oops' else '{{"name":"s-' || (event_id % 13) || '","attempt":' || (event_id % 4) || ',"durationMs":' || (case when event_id % 5 = 0 then '"1"' else '' || (event_id % 1000) end)
  || ',"eventType":"e' || (event_id % 3) || '","error":' || (case when event_id % 3 = 0 then 'null' else '"{{\\"name\\":\\"E' || (event_id % 5) || '\\",\\"message\\":\\"m' || (event_id % 2) || '\\"}}"' end)
  || ',"output":"o' || (event_id % 9) || '","redacted":' || (case when event_id % 11 = 0 then 'true' else 'false' end) || ',"retryDelayMs":' || (event_id % 50) || '}}' end detail
  from events)"""
PUBLIC = f"""{FULL_LOG}, m(kind, type) as (values {", ".join(map(str, events.PUBLIC_TYPES.items()))}),
parsed as (select *, case when json_valid(detail) then detail::json end j from full_log join m using (kind)),
public as (select instance_id, id event_id, created_at "timestamp", type,
  case when type not like 'workflow%' and type not in ('rollback_started', 'rollback_completed', 'rollback_errored') then j->>'$.name' end step_name,
  case when type like '%attempt_%' then cast(j->>'$.attempt' as bigint) end attempt,
  case when type = 'step_completed' and j->>'$.redacted' = 'true' then '[REDACTED]' when type in ('workflow_completed', 'step_completed') then j->>'$.output' end output,
  case when type = 'sleep_started' and json_type(j, '$.durationMs') <> 'VARCHAR' then cast(j->>'$.durationMs' as double) end duration_ms,
  case when type = 'wait_started' then j->>'$.eventType' end event_type, case when type like '%attempt_errored' then cast(j->>'$.retryDelayMs' as bigint) end retry_delay_ms,
  case when type in {ERRORS} then coalesce(json_extract_string(cast(j->>'$.error' as json), '$.name'), 'Error') end error_name,
  case when type in {ERRORS} then coalesce(json_extract_string(cast(j->>'$.error' as json), '$.message'), case type {" ".join(f"when '{k}' then '{v}'" for k, v in events.NO_MESSAGE.items())} end) end error_message
  from parsed)"""
COMMAND_ROWS = f"""
commands as (select event_id seq, user_id instance_id, ({TYPES})[event_id % 6 % 3 + 1] type, 's' || (event_id % 6) "name", event_id % 6 ordinal, ({COMMANDS})[event_id // 6 % 7 + 1] command,
  'v' || (event_id % 10) "value", 'x' || (event_id % 8) error, case when event_id % 4 = 0 then 'y' || (event_id % 3) end step_error from events),
met as (select *, min(seq) filter (command = 'ensure') over (partition by instance_id, type, name) first from commands)"""
COLUMNS = "instance_id, event_id, timestamp, type, step_name, attempt, output, duration_ms, event_type, retry_delay_ms, error_name, error_message"


def full_log(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    error = F.when(i % 3 == 0, "null").otherwise(F.format_string(r'"{\"name\":\"E%d\",\"message\":\"m%d\"}"', i % 5, i % 2))
    duration = F.when(i % 5 == 0, '"1"').otherwise((i % 1000).cast("string"))
    redacted = F.when(i % 11 == 0, "true").otherwise("false")
    form = '{"name":"s-%d","attempt":%d,"durationMs":%s,"eventType":"e%d","error":%s,"output":"o%d","redacted":%s,"retryDelayMs":%d}'
    detail = F.when(i % 7 == 0, None).when(i % 7 == 1, "{oops").otherwise(F.format_string(form, i % 13, i % 4, duration, i % 3, error, i % 9, redacted, i % 50))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % len(KINDS) + 1).cast("int"))
    return A.table(spark, d, "events").select(i.alias("id"), F.col("user_id").alias("instance_id"), kind.alias("kind"), K.epoch_ms(F.col("ts")).alias("created_at"), detail.alias("detail"))


def commands(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    one = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    text = lambda letter, n: F.concat(F.lit(letter), (i % n).cast("string"))
    return A.table(spark, d, "events").select(
        i.alias("seq"), F.col("user_id").alias("instance_id"), one(TYPES, i % 6 % 3).alias("type"), text("s", 6).alias("name"), (i % 6).alias("ordinal"),
        one(COMMANDS, F.floor(i / 6) % 7).alias("command"), text("v", 10).alias("value"), text("x", 8).alias("error"), F.when(i % 4 == 0, text("y", 3)).alias("step_error"),
    )


@query(f"with {PUBLIC} select * from public")
def public_events(spark: SparkSession, d: str) -> DataFrame:
    return events.public_events(full_log(spark, d)).select(*COLUMNS.split(", "))


@query(f"""with {PUBLIC}, {INSTANCES}, f as (select instance_id, min(event_id) last_id from public where type in ('workflow_completed', 'workflow_errored', 'workflow_terminated') and event_id % 4 = 0 group by 1)
select i.id instance_id, case when last_id is not null then 'event' when i.id % 3 = 0 then 'status' end ended_by, last_id from instances i left join f on i.id = f.instance_id""")
def feed_ends(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("id") % 3 == 0, "terminated").otherwise("running")
    return events.ends(events.public_events(full_log(spark, d)).where("event_id % 4 = 0"), A.instances(spark, d).withColumn("status", status))


@query(f"""with {PUBLIC}, parts as (
  select *, 'lifecycle' part from public where type in {events.LIFECYCLE} union all select *, 'step' from public where step_name <> ''
  union all select *, 'rollback_order' from public where type = 'rollback_step_started' union all select *, 'rollback_outcome' from public where type in ('rollback_completed', 'rollback_errored')
  union all select *, 'wait' from public where starts_with(type, 'wait_') union all select *, 'sleep' from public where starts_with(type, 'sleep_'))
select instance_id, part, type, step_name, attempt, event_type, duration_ms,
  row_number() over (partition by instance_id, part, case part when 'step' then step_name end order by event_id) position from parts""")
def trace_items(spark: SparkSession, d: str) -> DataFrame:
    return events.trace_items(events.public_events(full_log(spark, d)))


@query(f"""with {PUBLIC} select instance_id, step_name, min(event_id) first_id, count(*) events, count(attempt) attempts,
  arg_max(output, event_id) filter (type = 'step_completed' and output is not null) output,
  arg_max(error_name, event_id) filter (error_message is not null) error_name, arg_max(error_message, event_id) filter (error_message is not null) error_message
from public where step_name <> '' group by 1, 2""")
def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    return events.trace_steps(events.public_events(full_log(spark, d)))


@query("""with e as (select p_partkey probe, p_type status, p_size size, case when p_partkey % 17 = 0 then 'boom' end error from part where p_partkey % 5 <> 0),
a as (select p_partkey probe, p_type status, p_size + case when p_partkey % 7 = 0 then 1 else 0 end size, case when p_partkey % 19 = 0 then 'late' end error from part where p_partkey % 6 <> 0),
b as (select coalesce(e.probe, a.probe) probe, case when e.probe is null then 'missing' else e.error end expected_error, case when a.probe is null then 'missing' else a.error end actual_error,
  e.status is distinct from a.status or e.size is distinct from a.size other from e full join a on e.probe = a.probe)
select probe, expected_error, actual_error, expected_error is null and actual_error is null and other differs, expected_error is null and actual_error is null and not other passed from b""")
def probe_run_results(spark: SparkSession, d: str) -> DataFrame:
    rows, key = A.table(spark, d, "part"), F.col("p_partkey")
    size = lambda changed: (F.col("p_size") + F.when(changed, 1).otherwise(0)).alias("size")
    expected = rows.where(key % 5 != 0).select(key.alias("probe"), F.col("p_type").alias("status"), size(F.lit(False)), F.when(key % 17 == 0, "boom").alias("error"))
    actual = rows.where(key % 6 != 0).select(key.alias("probe"), F.col("p_type").alias("status"), size(key % 7 == 0), F.when(key % 19 == 0, "late").alias("error"))
    return events.run_results(expected, actual, "probe", ["status", "size"])


@query(f"""with {COMMAND_ROWS}, u as (select * from met where seq >= first)
select instance_id, type, name, min(ordinal) ordinal,
  arg_max(case command when 'ensure' then case when seq = first then case type when 'do' then 'running' else 'waiting' end end when 'complete' then 'completed' when 'timer_done' then 'completed' when 'retry' then 'waiting_retry' else 'failed' end, seq) state,
  nullif(arg_max(case when command = 'complete' then value when command = 'timer_done' or seq = first then '' end, seq), '') output,
  nullif(arg_max(case when command = 'fail' then coalesce(step_error, error) when command in ('fail_output', 'retry', 'timed_out') then error when command <> 'ensure' or seq = first then '' end, seq), '') error
from u group by 1, 2, 3""")
def step_states(spark: SparkSession, d: str) -> DataFrame:
    return writes.step_states(commands(spark, d))


@query(f"""with {COMMAND_ROWS}, k as (select seq, instance_id, name, case command when 'complete' then 'step.completed' when 'fail' then 'step.errored' when 'timed_out' then 'wait.timed_out'
  when 'timer_done' then case when type = 'sleep' then 'sleep.completed' end
  when 'ensure' then case when seq = first then case type when 'do' then 'step.started' when 'sleep' then 'sleep.started' else 'wait.started' end end end kind from met where seq >= first)
select * from k where kind is not null""")
def command_log(spark: SparkSession, d: str) -> DataFrame:
    return writes.command_log(commands(spark, d))


@query("""with recursive c as (select event_id seq, user_id instance_id, 's' || (event_id % 3) "name", case event_id // 3 % 5 when 0 then 'put' when 1 then 'delete' else 'wait_on' end command, event_id % 1000 wake_at,
  row_number() over (partition by user_id, event_id % 3 order by event_id) k from events),
s as (select instance_id, name, k, case when command <> 'delete' then wake_at end wake_at from c where k = 1
  union all select c.instance_id, c.name, c.k, case c.command when 'delete' then null when 'put' then c.wake_at else coalesce(s.wake_at, c.wake_at) end
  from s join c on c.instance_id = s.instance_id and c.name = s.name and c.k = s.k + 1)
select instance_id, 'sleep' type, name, 'sleep' kind, arg_max(w, k).w wake_at from (select instance_id, name, k, {'w': wake_at} w from s) group by 1, 2, 3, 4 having arg_max(w, k).w is not null""")
def open_timers(spark: SparkSession, d: str) -> DataFrame:
    i, turn = F.col("event_id"), F.floor(F.col("event_id") / 3) % 5
    rows = A.table(spark, d, "events").select(
        i.alias("seq"), F.col("user_id").alias("instance_id"), F.lit("sleep").alias("type"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("name"), F.lit("sleep").alias("kind"),
        F.when(turn == 0, "put").when(turn == 1, "delete").otherwise("wait_on").alias("command"), (i % 1000).alias("wake_at"),
    )
    return writes.timers(rows)


@query("""select p_brand workflow, p_size cron, max(p_partkey) seq, cast(trunc(arg_max(p_retailprice, p_partkey)) as bigint) cursor_ms from part group by 1, 2""")
def schedule_cursors(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select(F.col("p_brand").alias("workflow"), F.col("p_size").alias("cron"), F.col("p_partkey").alias("seq"), F.col("p_retailprice").cast("long").alias("cursor_ms"))
    return writes.last_written(rows, ["workflow", "cron"], "seq")


@query("""select p_partkey id, '{"a":[' || p_size || ',{"x":1,"y":null}],"b":{"c":"' || p_brand || '","d":true},"é":"' || p_type || '"}' canonical from part""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string('{ "é":"%s", "b": {"d":true, "c":"%s"}, "a": [%d, {"y":null,"x":1}] }', F.col("p_type"), F.col("p_brand"), F.col("p_size"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), K.canonical_json(text).alias("canonical"))
