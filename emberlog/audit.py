"""More registered queries: evidence behind verdicts, and what a journal's writes leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import kernel as K
from emberlog.operators import coverage, evidence, journal
from emberlog.plans import adapt as A
from emberlog.queries import INSTANCES, ITEMS, LOG, RANK, STATES_SQL, STEPS, UNRANK, VERDICTS, item_rows, query, requirement_rows

TIMEOUT_MS = 30 * A.DAY_MS
ORACLES = ["local", "hosted"]
GLOBS = ["PROMO*", "*ARD", "S*", "NOTHING*"]


@query(f"with {LOG} select instance_id, kind \"type\", min(id) event_id from log where id % 3 <> 0 group by 1, 2")
def next_buffered_event(spark: SparkSession, d: str) -> DataFrame:
    inbox = A.log(spark, d).select("id", "instance_id", F.col("kind").alias("type"), F.when(F.col("id") % 3 == 0, F.col("created_at")).alias("consumed_at"))
    return journal.next_buffered(inbox)


@query(f"""with {INSTANCES}, p as (select *, id % 5000 public_id, row_number() over (partition by id % 5000 order by created_at, id) k, count(*) over (partition by id % 5000) matches from instances)
select public_id, matches, id first_id, matches > 1 ambiguous from p where k = 1""")
def ambiguous_instances(spark: SparkSession, d: str) -> DataFrame:
    return journal.by_public_id(A.instances(spark, d).withColumn("public_id", F.col("id") % 5000), "public_id")


@query(f"""with {STEPS}, r as (select *, row_number() over (partition by instance_id, name order by ordinal desc) k from steps where type in ('do', 'waitForEvent'))
select instance_id, name, ordinal, type, state from r where k = 1""")
def step_lookup(spark: SparkSession, d: str) -> DataFrame:
    return journal.last_steps(A.numbered_steps(A.steps(spark, d)))


@query(f"""with {INSTANCES}, {LOG}, c as (select l.id, instance_id, l.created_at, case l.id % 2 when 0 then 'exec-a' else 'exec-b' end owner from log l)
select c.id, c.owner, case when i.id is null then 'no-instance' when lease_owner = owner and (lease_expires_at is null or lease_expires_at > c.created_at) then 'committed' else 'lease-lost' end outcome
from c left join instances i on c.instance_id = i.id""")
def fenced_commits(spark: SparkSession, d: str) -> DataFrame:
    commits = A.log(spark, d).select("id", "instance_id", "created_at", F.when(F.col("id") % 2 == 0, "exec-a").otherwise("exec-b").alias("owner"))
    return journal.fenced(commits, A.instances(spark, d)).select("id", "owner", "outcome")


@query(f"""with {STEPS} select instance_id, type, bool_and(state = 'completed') all_done, bool_or(state = 'completed') any_done, min(ordinal) filter (state = 'completed') first_done
from steps group by 1, 2""")
def parallel_combinators(spark: SparkSession, d: str) -> DataFrame:
    return journal.combined(A.numbered_steps(A.steps(spark, d)))


@query(f"""with {STEPS}, t as (select instance_id, ordinal, lead(created_at) over (partition by instance_id order by ordinal) - created_at took from steps)
select instance_id, ordinal, case when took is null then 'open' when took > {TIMEOUT_MS} then 'timed-out' else 'finished' end ended from t""")
def attempt_timeouts(spark: SparkSession, d: str) -> DataFrame:
    return journal.attempt_ends(A.numbered_steps(A.steps(spark, d)), TIMEOUT_MS).select("instance_id", "ordinal", "ended")


@query("""with p as (select p_partkey id, case p_partkey % 5 when 0 then 'cf_' || sha256(p_name) when 1 then repeat(p_name, 20) when 2 then '' else p_name end public_id from part)
select id, length(public_id) between 1 and 100 and not regexp_matches(public_id, '^cf_[0-9a-f]{64}$') valid from p""")
def instance_id_checks(spark: SparkSession, d: str) -> DataFrame:
    rest = F.col("p_partkey") % 5
    public = F.when(rest == 0, F.concat(F.lit("cf_"), F.sha2("p_name", 256))).when(rest == 1, F.repeat("p_name", 20)).when(rest == 2, "").otherwise(F.col("p_name"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), journal.valid_instance_id(public).alias("valid"))


@query(f"""with {INSTANCES}, {LOG}, e as (select id, instance_id * 7 instance_id, case when id % 10 = 0 then kind else replace(kind, '.', '_') end type from log)
select e.id, type, case when i.id is null then 'not-found' when status not in ('queued', 'running', 'waiting', 'waitingForPause') then 'not-running'
  when not regexp_matches(type, '^[A-Za-z0-9_-]{{1,100}}$') then 'bad-type' else 'sent' end outcome from e left join instances i on e.instance_id = i.id""")
def sent_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("id") % 10 == 0, F.col("kind")).otherwise(F.regexp_replace("kind", r"\.", "_"))
    sent = A.log(spark, d).select("id", (F.col("instance_id") * 7).alias("instance_id"), kind.alias("type"))
    status = A.instances(spark, d).select(F.col("id").alias("instance_id"), "status")
    return sent.join(status, "instance_id", "left").select("id", "type", journal.event_outcome(F.col("status"), F.col("type")).alias("outcome"))


@query(f"""with {STEPS}, r as (select instance_id, bool_or(state = 'failed') f from steps where type = 'do' group by 1)
select instance_id, case when f then 'failed' else 'complete' end outcome, case when f then 'errored' else 'terminated' end status from r""")
def rollback_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return journal.finished_rollbacks(A.steps(spark, d).where("type = 'do'").withColumn("failed", F.col("state") == "failed"))


@query(f"""with {ITEMS}, b as (select coalesce(i.container, b.container) container, i.fingerprint is distinct from b.fingerprint x from items i full join baseline b on i.id = b.id and i.container = b.container)
select container, bool_or(x) stale, count(*) filter (x) differing from b group by 1""")
def input_staleness(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    return evidence.stale_bundles(A.baseline(items), items, "container", "id", "fingerprint")


@query(f"""with {ITEMS}, p as (select container, kind, sha256(string_agg(fingerprint, chr(10) order by fingerprint)) h from items group by 1, 2)
select container, count(*) parts, sha256(string_agg(kind || ':' || h, chr(10) order by kind || ':' || h)) hash from p group by 1""")
def bundle_hashes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.bundle_hashes(A.items(spark, d), "container", "kind", "fingerprint")


@query(f"""with {VERDICTS}, v as (select profile, requirement, oracle, case when oracle = 'hosted' and probe % 4 = 0 then 'UNTESTED' else verdict end verdict from verdicts, (values ('local'), ('hosted')) o(oracle)),
s as (select profile, oracle, requirement, coalesce({UNRANK.format(f"min({RANK})")}, 'UNTESTED') state from v group by 1, 2, 3)
select profile, oracle, count(*) filter (state = 'VERIFIED') verified, count(*) denominator from s group by 1, 2""")
def oracle_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.for_each_oracle(A.verdicts(spark, d), ORACLES)
    rows = rows.withColumn("verdict", F.when((F.col("oracle") == "hosted") & (F.col("probe") % 4 == 0), "UNTESTED").otherwise(F.col("verdict")))
    keys = ["profile", "oracle", "requirement"]
    states = coverage.requirement_states(rows.select(*keys).distinct(), rows, keys)
    return states.groupBy("profile", "oracle").agg(F.count_if(F.col("state") == "VERIFIED").alias("verified"), F.count("*").alias("denominator"))


@query(f"with {STATES_SQL} select profile, requirement, case state when 'UNTESTED' then 'not-run' when 'STALE' then 'stale' when 'VERIFIED' then 'passed' else 'failed' end scenario from states")
def scenario_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.col("state")
    return requirement_rows(spark, d).select("profile", "requirement", evidence.scenario_state(state != "UNTESTED", state == "STALE", state == "VERIFIED").alias("scenario"))


@query(f"""with {ITEMS} select id, case when b.id is null then 'only-computed' when i.id is null then 'only-proposed' else 'differs' end side
from items i full join baseline b using (id) where i.fingerprint is distinct from b.fingerprint""")
def proposed_baseline(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    return evidence.unequal(A.baseline(items), items, "id", ["kind", "container", "fingerprint"])


@query(f"""with {ITEMS}, links as (select id, id % 40 capability from items where id % 3 = 0), by_way as (select id, id % 17 requirement from items where id % 2 = 0)
select id, capability from links union select id, requirement + 100 from by_way where requirement < 10""")
def capability_index(spark: SparkSession, d: str) -> DataFrame:
    ids = A.items(spark, d).select("id")
    none = F.lit(None).cast("long")
    straight = ids.where("id % 3 = 0").select("id", (F.col("id") % 40).alias("capability"), none.alias("requirement"))
    declared = spark.range(10).select(none.alias("id"), (F.col("id") + 100).alias("capability"), F.col("id").alias("requirement"))
    return evidence.reverse_index(straight.unionByName(declared), ids.where("id % 2 = 0").withColumn("requirement", F.col("id") % 17), "id", "capability", "requirement")


@query(f"with {VERDICTS} select requirement, case when bool_or(probe % 6 = 0) then 'in-scope' else 'excluded' end target from verdicts group by 1")
def requirement_targets(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("probe") % 6 == 0, "in-scope").otherwise("excluded")
    return A.verdicts(spark, d).groupBy("requirement").agg(evidence.any_in_scope(target).alias("target"))


@query(f"""with {STATES_SQL}, c as (select profile, count(*) filter (state = 'VERIFIED') * 1000.0 / count(*) v from states group by 1),
t(profile, least) as (values ('de', 0.0), ('en', 99.0), ('fr', 50.0), ('zz', 10.0))
select profile, cast(least as double) least, cast(coalesce(floor(cast(v as double) + 0.5) / 10, 0) as double) measured from t left join c using (profile) where coalesce(floor(cast(v as double) + 0.5) / 10, 0) < least""")
def threshold_failures(spark: SparkSession, d: str) -> DataFrame:
    least = spark.createDataFrame([("de", 0.0), ("en", 99.0), ("fr", 50.0), ("zz", 10.0)], "profile string, least double")
    return evidence.below_threshold(coverage.cells(requirement_rows(spark, d), "profile"), least, "profile")


@query(f"""with {ITEMS}, c as (select id, count(*) n from (select id from baseline union all select id from baseline where id % 29 = 0) group by 1), b as (select i.id d, c.id c, n, coalesce(i.id, c.id) id from items i full join c on i.id = c.id)
select id, 'unclassified' fault from b where c is null union all select id, 'stale-row' from b where d is null union all select id, 'duplicate' from b where n > 1""")
def classification_check(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    rows = A.baseline(items).select("id")
    return evidence.classification_faults(items, rows.unionByName(rows.where("id % 29 = 0")), "id")


@query(f"""with {ITEMS}, b as (select coalesce(i.container, b.container) container, b.id b, i.id i from items i full join baseline b on i.id = b.id and i.container = b.container)
select container, count(*) filter (i is null) missing, count(*) filter (b is null) unexpected, count(*) filter (i is null or b is null) = 0 passed from b group by 1""")
def contract_sets(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    return evidence.compared_sets(A.baseline(items), items, "container", "id")


@query(f"""with g(root, pre, post) as (values {", ".join(str((g, *g.split("*"))) for g in GLOBS)}), m as (select p_partkey, root from part join g on starts_with(p_type, pre) and ends_with(p_type, post)),
n as (select *, count(*) over (partition by p_partkey) k from m)
select root, count(p_partkey) matches, count(*) filter (k > 1) shared from g left join n using (root) group by 1""")
def root_globs(spark: SparkSession, d: str) -> DataFrame:
    return evidence.root_matches(A.table(spark, d, "part"), GLOBS, "p_type")


@query("""with t as (select p_name name, p_size % 5 depth, p_partkey position, p_brand version from part), r as (select *, row_number() over (partition by name order by depth, position) k from t)
select name, version from r where k = 1""")
def first_versions(spark: SparkSession, d: str) -> DataFrame:
    tree = A.table(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("depth"), F.col("p_partkey").alias("position"), F.col("p_brand").alias("version"))
    return evidence.first_versions(tree, "name", "depth", "position", "version")


@query(f"""with {VERDICTS}, r as (select probe // 10 run, case when probe % 97 = 0 then 'other' else 'this' end candidate, verdict from verdicts)
select run, case when count(distinct candidate) > 1 then 'mixed-candidates' when bool_or(verdict = 'BLOCKED') then 'error' when bool_or(verdict = 'DIVERGENT') then 'divergent' else 'pass' end verdict from r group by 1""")
def run_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = A.verdicts(spark, d).select(
        F.expr("probe div 10").alias("run"), F.when(F.col("probe") % 97 == 0, "other").otherwise("this").alias("candidate"), (F.col("verdict") == "BLOCKED").alias("failed"), (F.col("verdict") == "DIVERGENT").alias("differs")
    )
    return evidence.run_verdicts(rows, "run", "candidate")


@query(f"""with {LOG}, h as (select instance_id, id, sha256(detail) hash from log), b as (select *, lag(hash) over (partition by instance_id order by id) before from h),
p as (select *, case when id % 41 = 0 then 'x' else before end previous from b)
select instance_id, id, case when before is null then 'names-a-previous' else 'broken-link' end fault from p where previous is distinct from before""")
def receipt_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = A.log(spark, d).select("instance_id", "id", F.sha2("detail", 256).alias("hash"))
    before = F.lag("hash").over(evidence.W.partitionBy("instance_id").orderBy("id"))
    return evidence.chain_faults(rows.withColumn("previous", F.when(F.col("id") % 41 == 0, "x").otherwise(before)), "instance_id", "id")


@query(f"""with {ITEMS} select i.id, case when b.fingerprint is null or b.fingerprint = i.fingerprint then 'no-update' when i.id % 2 = 0 then 'proposed' else 'blocked' end status from items i left join baseline b using (id)""")
def update_candidates(spark: SparkSession, d: str) -> DataFrame:
    items = A.items(spark, d)
    new = A.baseline(items).select("id", F.col("fingerprint").alias("candidate"))
    return items.join(new, "id", "left").select("id", evidence.update_status(F.col("fingerprint"), F.col("candidate"), F.col("id") % 2 == 0).alias("status"))


@query(f"with {ITEMS}, {VERDICTS} select id, kind, container from items where id not in (select probe % 3000 from verdicts)")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return item_rows(spark, d).where("state = 'UNMAPPED'").select("id", "kind", "container")


@query(f"""with {LOG}, r as (select instance_id batch, id "index", case when id % 5 = 0 then null when id % 997 = 0 then 'terminate' else 'w-' || (id % 31) end public_id from log),
existing as (select distinct 'w-' || (p_partkey % 31) public_id from part where p_partkey % 31 in (1, 4)),
b as (select batch, count(*) <= 100 and bool_and(public_id is null or (regexp_matches(public_id, '^[a-zA-Z0-9_][a-zA-Z0-9_-]*$') and length(public_id) <= 100
  and public_id not in ('batch', 'terminate', 'terminateAll') and not regexp_matches(public_id, '^cf_[0-9a-f]{{64}}$'))) accepted from r group by 1)
select batch, "index", public_id, case when not accepted then 'refused' when public_id is null then 'created'
  when exists (select 1 from r e where e.batch = r.batch and e.public_id = r.public_id and e."index" < r."index") then '10415'
  when public_id in (select public_id from existing) then '10405' else 'created' end outcome from r join b using (batch)""")
def batch_create_outcomes(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("w-"), (F.col(c) % 31).cast("string"))
    public = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 997 == 0, "terminate").otherwise(name("id"))
    requests = A.log(spark, d).select(F.col("instance_id").alias("batch"), F.col("id").alias("index"), public.alias("public_id"))
    existing = A.table(spark, d, "part").where("p_partkey % 31 in (1, 4)").select(name("p_partkey").alias("public_id"))
    return journal.batch_created(requests, existing)


@query(r"""with t as (select p_partkey id, case p_partkey % 8 when 0 then p_size || ' days' when 1 then p_size || '' when 2 then p_size || '.5 hours' when 3 then p_size || ' moons'
  when 4 then 'soon' when 5 then '-' || p_size || ' weeks' when 6 then p_size || ' years' else ' ' || p_size || ' ' end text from part),
m as (select *, regexp_extract(text, '^([^ ]+) +(\w\w*?)s?$', 1) a, regexp_extract(text, '^([^ ]+) +(\w\w*?)s?$', 2) u from t),
v as (select id, text, coalesce(try_cast(trim(text) as double), try_cast(a as double) * case u when 'day' then 86400000 when 'hour' then 3600000 when 'week' then 604800000 when 'year' then 31557600000 else 1 end) ms from m)
select id, text, case when ms > 0 then ms end ms from v""")
def batch_retention(spark: SparkSession, d: str) -> DataFrame:
    rest, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    forms = {0: (size, " days"), 1: (size,), 2: (size, ".5 hours"), 3: (size, " moons"), 4: ("soon",), 5: ("-", size, " weeks"), 6: (size, " years"), 7: (" ", size, " ")}
    text = F.coalesce(*[F.when(rest == k, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])) for k, parts in forms.items()])
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return rows.withColumn("ms", K.batch_retention_ms(F.col("text")))


@query(f"""with {INSTANCES}, w(workflow, success, error) as (values ('1-URGENT', 14, null), ('2-HIGH', null, 1)), p(plan, days) as (values (0, 3), (1, 7)),
r as (select id, created_at, status, coalesce(case when id % 4 = 0 then id % 9 end, success, days) s, coalesce(case when id % 6 = 0 then id % 9 end, error, days) e
  from instances left join w using (workflow) left join p on plan = id % 3)
select id, case status when 'queued' then created_at + s * 86400000 when 'rollingBack' then created_at + e * 86400000 end expires_at from r""")
def retention_chain(spark: SparkSession, d: str) -> DataFrame:
    days, schema = A.DAY_MS, "{} string, success_ms long, error_ms long"
    workflows = spark.createDataFrame([("1-URGENT", 14 * days, None), ("2-HIGH", None, days)], schema.format("workflow"))
    plans = spark.createDataFrame([(name, n * days, n * days) for name, n in K.PLAN_DAYS.items()], schema.format("plan"))
    own = lambda k: F.when(F.col("id") % k == 0, (F.col("id") % 9) * days)
    rows = A.instances(spark, d).withColumn("plan", F.when(F.col("id") % 3 == 0, "free").when(F.col("id") % 3 == 1, "paid"))
    rows = journal.with_retention(rows.withColumns({"own_success_ms": own(4), "own_error_ms": own(6)}), workflows, plans)
    ended = A.choice(F.col("status"), {"queued": "complete", "rollingBack": "errored"})
    return rows.select("id", journal.expires_at(ended, F.col("created_at"), F.col("success_ms"), F.col("error_ms")).alias("expires_at"))
