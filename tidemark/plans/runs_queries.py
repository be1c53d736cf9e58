"""Queries of freshness, lineage, run histories and records, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lineage, records, runs
from tidemark.session import table

_NOW = "2024-06-12 15:30:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _specs(spark):
    rows = [("factors", "daily", 60, 90, 4320), ("scores", "weekly", 60, 600, 14400), ("news", "continuous", 240, 30, 300), ("parity", "event_driven", 60, 60, 60), ("absent", "daily", 60, 60, 1440), ("regimes", "weekly", 60, 100_000, 60)]
    return spark.createDataFrame(rows, "artifact_id string, cadence string, every_minutes int, sla_minutes int, max_age_minutes int")


def _objects(spark, sf):
    e = table(spark, sf, "run_executions").filter("stop_date < timestamp_ntz'2024-06-12 15:30:00'")
    return e.select(F.concat(F.element_at(F.split("state_machine_arn", ":"), -1), F.lit("/"), "execution_name", F.lit(".json")).alias("key"), F.col("stop_date").cast("timestamp").alias("modified"))


def freshness_states(spark, sf):
    specs = _specs(spark)
    prefixes = specs.select("artifact_id", F.concat(F.lit("zq-"), "artifact_id").alias("prefix"), F.lit(".json").alias("suffix"))
    out = lineage.freshness(specs, lineage.newest_under(_objects(spark, sf), prefixes), _now())
    return out.withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm"))


def cycle_completion(spark, sf):
    e = table(spark, sf, "run_executions")
    state = F.when(F.col("status") == "SUCCEEDED", "fresh").when(F.col("status") == "RUNNING", "probe_failed").otherwise("missing")
    return lineage.cycle_completion(e.select(F.to_date("start_date").alias("cycle"), (F.col("redrive_count") == 0).alias("critical"), state.alias("state")), "cycle")


def _edges(spark, sf):
    p = table(spark, sf, "part")
    return p.filter("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("greatest(p_partkey div 3, 1)")))).alias("depends_on"))


def dag_reachable(spark, sf):
    return lineage.reachable(_edges(spark, sf), "id", "depends_on")


def dag_leaves(spark, sf):
    return lineage.reachable_leaves(_edges(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("leaf").alias("first_leaf"))


def dag_root_cause(spark, sf):
    gaps = table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("id"))
    return lineage.root_causes(_edges(spark, sf), gaps)


def dag_faults(spark, sf):
    nodes = table(spark, sf, "part").filter("p_partkey % 11 != 5").select(F.col("p_partkey").alias("id"))
    return lineage.graph_faults(nodes, _edges(spark, sf))


def dag_cycles(spark, sf):
    loop = _edges(spark, sf).union(spark.range(1).selectExpr("cast(3 as bigint) id", "cast(97 as bigint) depends_on"))
    return lineage.on_cycles(loop).select("id", "depends_on")


def windowed_artifact(spark, sf):
    o = table(spark, sf, "rag_documents").filter("doc_type = '10-K'").select(F.col("filed_date").alias("source_date"), F.col("id").alias("key"))
    asked = table(spark, sf, "alpha_signals").select(F.to_date("signal_ts").alias("run_date")).filter("run_date is not null").distinct()
    return lineage.windowed_artifact(o, asked, 10)


def fallback_keys(spark, sf):
    asked = table(spark, sf, "alpha_signals").select(F.to_date("signal_ts").alias("run_date")).filter("run_date is not null").distinct()
    return lineage.fallback_dates(asked)


def module_health(spark, sf):
    e = table(spark, sf, "run_executions").filter("stop_date < timestamp_ntz'2024-06-12 15:30:00'").select(F.col("state_machine_arn").alias("module"), F.col("stop_date").alias("finished"), "status")
    modules = table(spark, sf, "run_history").select(F.col("state_machine_arn").alias("module")).distinct()
    return lineage.module_health(e, modules, _now())


def success_rate(spark, sf):
    e = table(spark, sf, "run_executions")
    return lineage.success_rate(e, ["state_machine_arn"], F.col("status") == "SUCCEEDED", 80.0)


def _events(spark, sf):
    return runs.events_once(table(spark, sf, "run_history"), "execution_arn", "event_id", "recorded_at")


def entered_states(spark, sf):
    return runs.entered_states(_events(spark, sf), "execution_arn", "event_id", F.col("state_entered_event_details.name"))


def state_durations(spark, sf):
    return runs.state_spans(_events(spark, sf), "execution_arn", "event_id", "event_ts", F.col("state_entered_event_details.name"), F.col("state_exited_event_details.name"))


def failing_state(spark, sf):
    return runs.failing_state(_events(spark, sf), "execution_arn", "event_id", F.col("state_entered_event_details.name"), F.col("event_type").isin("TaskFailed", "ExecutionFailed"))


def run_dates(spark, sf):
    e = table(spark, sf, "run_executions")
    return e.select("execution_arn", runs.run_date(F.col("input"), F.col("execution_name"), F.col("start_date")).alias("run_date"))


def latest_runs(spark, sf):
    e = table(spark, sf, "run_executions").select("state_machine_arn", "start_date", "execution_arn", "status")
    return runs.latest_runs(e, "state_machine_arn", "start_date", "execution_arn", 3)


def _cycles(spark, sf):
    return table(spark, sf, "run_executions").select("state_machine_arn", F.trunc("start_date", "month").alias("cycle"), "start_date", "status", (F.col("redrive_count") % 3).cast("string").alias("cause"))


def reliability_window(spark, sf):
    return runs.reliability(_cycles(spark, sf), "state_machine_arn", "cycle", "start_date", F.col("status") == "SUCCEEDED", F.concat_ws(":", "status", "cause"))


def clean_streak(spark, sf):
    c = _cycles(spark, sf).groupBy("state_machine_arn", "cycle").agg(F.every(F.col("status") == "SUCCEEDED").alias("clean"))
    return runs.clean_streak(c, "state_machine_arn", "cycle", F.col("clean"))


def status_islands(spark, sf):
    e = table(spark, sf, "run_executions").filter("start_date is not null")
    return runs.runs_of(e, ["state_machine_arn"], "start_date", F.col("status")).select("state_machine_arn", "value", "first", "last", "length")


def coverage_sweep(spark, sf):
    h = table(spark, sf, "run_history").select("execution_arn", "state_machine_arn", F.col("state_entered_event_details.name").alias("stage"), F.col("state_exited_event_details.name").alias("left"))
    entered = h.filter("stage is not null").select("execution_arn", "stage")
    verdicts = h.filter("left is not null").select("execution_arn", F.col("left").alias("stage"), (F.length("left") % 5 == 0).alias("finding"))
    stages = h.filter("stage is not null").groupBy("state_machine_arn", "stage").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("state_machine_arn", "stage")
    declared = table(spark, sf, "run_executions").select("execution_arn", "state_machine_arn").join(stages, "state_machine_arn").select("execution_arn", "stage")
    return runs.coverage(declared, verdicts, entered, ["execution_arn", "stage"])


def record_dedup(spark, sf):
    d = table(spark, sf, "documents").withColumn("hash", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256))
    return records.earliest(d, ["hash"], "published_at", "doc_id").select("doc_id", "hash")


def teacher_counts(spark, sf):
    return records.teachers(table(spark, sf, "documents"), "lang")


def mask_secrets(spark, sf):
    return table(spark, sf, "rag_documents").select("id", records.mask(F.col("title")).alias("masked"))


def secret_scan(spark, sf):
    k = records.secret_kinds(F.concat_ws(" ", "url", "external_id", "title"))
    return table(spark, sf, "rag_documents").select("id", F.array_join(k, ",").alias("kinds")).filter("kinds != ''")


def document_secrets(spark, sf):
    """Every text of the corpus masked, with the kinds of secrets it shows."""
    return table(spark, sf, "documents").select("doc_id", records.mask(F.col("text")).alias("masked"), F.array_join(records.secret_kinds(F.col("text")), ",").alias("kinds"))


def path_assertion(spark, sf):
    r = table(spark, sf, "run_executions")
    return r.select("execution_arn", records.path_assertion(F.col("input"), "pipeline_role", "eq", "weekly").alias("weekly"), records.path_assertion(F.col("input"), "shards[0].shard", "lte", 0).alias("first_shard"))


CONTRACT = {
    "type": "object",
    "required": ["pipeline_role", "run_date"],
    "properties": {
        "pipeline_role": {"enum": ["weekly", "weekday", "eod", "backfill", "audit", "canary", "refresh", "replay"]},
        "run_date": {"type": "string", "pattern": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"},
        "shards": {"type": "array", "items": {"type": "object", "required": ["shard", "artifacts"], "properties": {"shard": {"type": "integer", "minimum": 0}, "artifacts": {"type": ["array", "object"]}}}},
    },
}


def contract_errors(spark, sf):
    e = records.conformance_errors(CONTRACT)(F.col("input"))
    return table(spark, sf, "run_executions").select("execution_arn", F.array_join(e, "; ").alias("errors")).filter("errors != ''")


def decoded_inputs(spark, sf):
    v = records.decoded(F.col("output"))
    return table(spark, sf, "run_executions").select("execution_arn", F.try_variant_get(v, "$.pipeline_role", "string").alias("role"), F.try_variant_get(v, "$.run_date", "string").alias("run_date"))


def canonical_hashes(spark, sf):
    return table(spark, sf, "run_executions").select("execution_arn", records.canonical_hash(F.col("input")).alias("hash"))


def truncated_snapshots(spark, sf):
    t = records.truncated(400)(F.col("output"))
    return table(spark, sf, "run_executions").select("execution_arn", F.length(t).alias("n"), t.alias("snapshot"))


_QUERIES = [freshness_states, cycle_completion, dag_reachable, dag_leaves, dag_root_cause, dag_faults, dag_cycles, windowed_artifact, fallback_keys, module_health, success_rate, entered_states, state_durations, failing_state, run_dates, latest_runs, reliability_window, clean_streak, status_islands, coverage_sweep, record_dedup, teacher_counts, mask_secrets, secret_scan, document_secrets, path_assertion, contract_errors, decoded_inputs, canonical_hashes, truncated_snapshots]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_ONCE = "ev as (select * from run_history qualify row_number() over (partition by execution_arn, event_id order by recorded_at nulls last) = 1)"
_EDGES = "e as (select p_partkey id, p_partkey // 2 depends_on from part where p_partkey > 1 union select p_partkey, greatest(p_partkey // 3, 1) from part where p_partkey > 1)"
_CYC = "c as (select state_machine_arn m, date_trunc('month', start_date)::date cycle, start_date, status, status = 'SUCCEEDED' ok, concat_ws(':', status, (redrive_count % 3)::varchar) cause from run_executions)"


def oracle_sql() -> dict[str, str]:
    closure = f"{_EDGES}, r as (select id, depends_on, 1 distance from e union select r.id, e.depends_on, distance + 1 from r join e on e.id = r.depends_on)"
    state = "case when coalesce(age <= ma, false) or cadence = 'event_driven' then 'fresh' when epoch(n - tick) / 60 < sla then 'grace_period' when newest is null then 'missing' else 'stale' end"
    kinds = ", ".join(f"case when regexp_matches(t, {p.replace(chr(39), chr(39) * 2)!r}) then '{k}' end" if "'" not in p else f"case when regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') then '{k}' end" for k, p in sorted(records.SECRETS.items()))
    return {
        "freshness_states": f"""with s(artifact_id, cadence, em, sla, ma) as (values ('factors', 'daily', 60, 90, 4320), ('scores', 'weekly', 60, 600, 14400), ('news', 'continuous', 240, 30, 300), ('parity', 'event_driven', 60, 60, 60), ('absent', 'daily', 60, 60, 1440), ('regimes', 'weekly', 60, 100000, 60)),
o as (select split_part(state_machine_arn, ':', -1) m, stop_date from run_executions where stop_date < timestamp '{_NOW}'),
x as (select s.*, timestamp '{_NOW}' n, (select max(stop_date) from o where starts_with(m, 'zq-' || artifact_id)) newest,
case cadence when 'daily' then timestamp '2024-06-12 13:00' when 'weekly' then timestamp '2024-06-08 09:00' when 'continuous' then time_bucket(interval 240 minute, timestamp '{_NOW}', timestamp '1970-01-01') else timestamp '2024-06-12' end tick from s),
y as (select *, floor((epoch(n)::bigint - floor(epoch(newest))::bigint) / 60)::bigint age from x)
select artifact_id, cadence, strftime(tick, '%Y-%m-%d %H:%M') tick, case cadence when 'weekly' then '2024-W23' when 'continuous' then 'continuous_240m_' || (epoch(tick)::bigint // 14400) when 'event_driven' then 'event_driven_2024-06-12' else '2024-06-12' end label,
age age_minutes, {state} state from y""",
        "cycle_completion": """select start_date::date cycle, count(*) filter (where redrive_count = 0) n_critical,
case when bool_or(redrive_count = 0 and status not in ('SUCCEEDED', 'RUNNING')) then 'incomplete' when bool_or(redrive_count = 0 and status = 'RUNNING') then 'indeterminate' else 'complete' end verdict
from run_executions group by 1""",
        "dag_reachable": f"with recursive {closure} select id, depends_on, min(distance) distance from r group by 1, 2",
        "dag_leaves": f"with recursive {closure}, d as (select distinct depends_on id, id leaf from r), l as (select * from d where leaf not in (select depends_on from e)) select id, count(*) n_leaves, min(leaf) first_leaf from l group by 1",
        "dag_root_cause": f"""with recursive {_EDGES}, g as (select p_partkey id from part where p_size < 20), w as (select * from e where id in (from g) and depends_on in (from g)),
r as (select id, id root from g union select r.id, w.depends_on from r join w on w.id = r.root) select id, root from r where root not in (select id from w)""",
        "dag_faults": f"with {_EDGES}, x as (select id from e union select depends_on from e) select 'dangling' fault, id node from x where id not in (select p_partkey from part where p_partkey % 11 <> 5)",
        "dag_cycles": f"""with recursive {_EDGES}, f as (select * from e union select 3, 97), r as (select id, depends_on d from f union select r.id, f.depends_on from r join f on f.id = r.d),
c as (select id from r where id = d) select distinct f.id, f.depends_on from f where (f.id in (from c) or f.id in (select d from r where id in (from c))) and (f.depends_on in (from c) or f.depends_on in (select id from r where d in (from c)))""",
        "windowed_artifact": """with o as (select filed_date d, max(id) k from rag_documents where doc_type = '10-K' group by 1), a as (select distinct signal_ts::date run_date from alpha_signals where signal_ts is not null),
b as (select run_date, max(d) d from a join o on d between run_date - 10 and run_date group by 1)
select a.run_date, k "key", b.d source_date, a.run_date - b.d age_days from a left join b using (run_date) left join o on o.d = b.d""",
        "fallback_keys": """with a as (select distinct signal_ts::date run_date from alpha_signals where signal_ts is not null)
select run_date, run_date - p::int candidate, p::int priority from a, range(0, 6) t(p) where p = 0 or isodow(run_date - p::int) < 6""",
        "module_health": f"""with m as (select distinct state_machine_arn module from run_history),
l as (select state_machine_arn module, max(struct_pack(f := stop_date, s := status)) x from run_executions where stop_date < timestamp '{_NOW}' group by 1)
select module, coalesce(x.s, 'unknown') status, coalesce(round((epoch(timestamp '{_NOW}')::bigint - floor(epoch(x.f))::bigint) / 3600.0, 2), -1) age_hours,
coalesce((epoch(timestamp '{_NOW}')::bigint - floor(epoch(x.f))::bigint) / 3600.0 > 48, true) stale from m left join l using (module)""",
        "success_rate": "select state_machine_arn, count(*) filter (where status = 'SUCCEEDED') n_ok, count(*) n, round(100 * n_ok / n, 6) rate, 100 * n_ok / n >= 80 passed from run_executions group by 1",
        "entered_states": f"""with {_ONCE}, x as (select execution_arn, event_id, state_entered_event_details.name s from ev where state_entered_event_details.name is not null),
y as (select *, lag(s) over (partition by execution_arn order by event_id) b from x)
select execution_arn, row_number() over (partition by execution_arn order by event_id) "position", s state from y where b is null or b <> s""",
        "state_durations": f"""with {_ONCE}, x as (select execution_arn, event_ts, state_entered_event_details.name s, 1 d from ev union all select execution_arn, event_ts, state_exited_event_details.name, -1 from ev)
select execution_arn, s state, count(*) filter (where d = 1) n_entered, min(event_ts) filter (where d = 1) started, max(event_ts) filter (where d = -1) ended,
case when count(*) filter (where d = 1) > count(*) filter (where d = -1) then 'running' else 'done' end status from x where s is not null group by 1, 2""",
        "failing_state": f"""with {_ONCE}, f as (select execution_arn, min(event_id) a from ev where event_type in ('TaskFailed', 'ExecutionFailed') group by 1),
l as (select e.execution_arn, arg_max(state_entered_event_details.name, event_id) s from ev e join f using (execution_arn) where event_id < a and state_entered_event_details.name is not null group by 1)
select execution_arn, s failing_state from f left join l using (execution_arn)""",
        "run_dates": r"""select execution_arn, coalesce(try_cast(case when json_valid(input) and regexp_full_match(json_extract_string(input, '$.run_date'), '\d{4}-\d{2}-\d{2}') then json_extract_string(input, '$.run_date') end as date),
try_cast(nullif(regexp_extract(execution_name, '\d{4}-\d{2}-\d{2}'), '') as date), start_date::date) run_date from run_executions""",
        "decoded_inputs": """with a as (select execution_arn, case when json_valid(output) then output::json end j from run_executions),
b as (select execution_arn, case json_type(j) when 'OBJECT' then j when 'VARCHAR' then case when json_valid(j ->> '$') and json_type((j ->> '$')::json) = 'OBJECT' then (j ->> '$')::json end end j from a)
select execution_arn, j ->> '$.pipeline_role' as "role", j ->> '$.run_date' run_date from b""",
        "latest_runs": "select state_machine_arn, start_date, execution_arn, status, row_number() over (partition by state_machine_arn order by start_date desc, execution_arn) recency from run_executions qualify recency <= 3",
        "reliability_window": f"""with {_CYC}, x as (select *, row_number() over (partition by m, cycle order by start_date) a from c),
p as (select m, cycle, count(*) attempts, min(a) filter (where ok) ats from x group by 1, 2), k as (select distinct m, cycle, cause from c where not ok),
f as (select *, min(cycle) over (partition by m, cause) fc from k), n as (select m, cycle, count(*) filter (where fc = cycle) nc, count(*) filter (where fc < cycle) rc from f group by 1, 2)
select m state_machine_arn, cycle, attempts, ats attempts_to_success, coalesce(ats > 1, false) recovered, coalesce(nc, 0) new_causes, coalesce(rc, 0) repeated_causes from p left join n using (m, cycle)""",
        "clean_streak": f"""with {_CYC}, g as (select m, cycle, bool_and(ok) clean from c group by 1, 2), l as (select m, max(cycle) filter (where not clean) last from g group by 1)
select m state_machine_arn, count(*) filter (where last is null or cycle > last) clean_streak from g join l using (m) group by 1""",
        "status_islands": """with x as (select state_machine_arn, start_date, status, row_number() over (partition by state_machine_arn order by start_date) - row_number() over (partition by state_machine_arn, status order by start_date) i from run_executions where start_date is not null)
select state_machine_arn, status as "value", min(start_date) "first", max(start_date) "last", count(*) length from x group by state_machine_arn, status, i""",
        "coverage_sweep": """with h as (select execution_arn, state_machine_arn, state_entered_event_details.name stage, state_exited_event_details.name lft from run_history),
en as (select distinct execution_arn, stage from h where stage is not null), v as (select execution_arn, lft stage, bool_or(length(lft) % 5 = 0) finding from h where lft is not null group by 1, 2),
st as (select state_machine_arn, stage from h where stage is not null group by 1, 2 having count(*) > 3), d as (select distinct execution_arn, stage from run_executions join st using (state_machine_arn))
select coalesce(d.execution_arn, v.execution_arn) execution_arn, coalesce(d.stage, v.stage) stage,
case when d.stage is null then 'unmeasured' when v.finding then 'finding' when v.stage is not null then 'covered' when en.stage is not null then 'absent' else 'not_entered' end coverage
from d full join v on d.execution_arn = v.execution_arn and d.stage = v.stage left join en on en.execution_arn = coalesce(d.execution_arn, v.execution_arn) and en.stage = coalesce(d.stage, v.stage)""",
        "record_dedup": r"with h as (select doc_id, published_at, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) hash from documents) select doc_id, hash from h qualify row_number() over (partition by hash order by published_at nulls last, doc_id) = 1",
        "teacher_counts": "select coalesce(lang, 'unknown') teacher, count(*) n from documents group by 1",
        "mask_secrets": r"select id, array_to_string(list_transform(regexp_extract_all(title, '\s+|\S+'), lambda w: case when length(w) >= 8 and not regexp_matches(w, '^\s') then '***[len=' || length(w) || ']' else w end), '') masked from rag_documents",
        "secret_scan": f"with t as (select id, concat_ws(' ', url, external_id, title) t from rag_documents), k as (select id, concat_ws(',', {kinds}) kinds from t) select * from k where kinds <> ''",
        "path_assertion": """select execution_arn, coalesce(case when json_valid(input) then json_extract_string(input, '$.pipeline_role') end = 'weekly', false) weekly,
coalesce(try_cast(case when json_valid(input) then json_extract_string(input, '$.shards[0].shard') end as double) <= 0, false) first_shard from run_executions""",
    }
