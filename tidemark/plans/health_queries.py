"""Queries of the freshness ladder, completeness, alert decisions, module health and inventory checks, with the same in SQL."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import freshness, inventory, lineage
from tidemark.plans.runs_queries import _EDGES, _edges
from tidemark.session import table

_NOWS = {"2024-06-12 15:30:00": "2024-06-10", "2024-06-19 15:30:00": "2024-06-17"}  # a session day and a holiday, with the floor's day
_SPECS = [
    ("factors", "data/{date}.json", "daily", 1440, 90, "2023-01-01", 0, True, None, None, None, None),
    ("prices", "prices/{trading_day}.parquet", "daily", 1440, 90, "2023-01-01", 0, False, None, None, None, None),
    ("scores", "scores/{cycle_label}.json", "weekly", 10080, 600, "2023-01-01", 2, False, None, None, None, None),
    ("young", "young.json", "weekly", 10080, 600, "2024-06-10", 2, False, None, None, None, None),
    ("news", "news.json", "continuous", 240, 30, "2023-01-01", 3, False, None, None, None, None),
    ("feed", "feed.json", "continuous", 1440, 60, "2023-01-01", 3, False, "trading_days", None, None, None),
    ("ticks", "ticks.json", "continuous", 5, 5, "2023-01-01", 3, False, None, 14, 20, None),
    ("evening", "evening.json", "continuous", 5, 5, "2023-01-01", 3, False, "market_hours", 16, 20, None),
    ("parity", "parity.json", "event_driven", 60, 60, "2023-01-01", 0, False, None, None, None, None),
    ("blind", "blind.json", "daily", 1440, 60, "2023-01-01", 0, False, None, None, None, "403"),
    ("absent", "absent/{date}.csv", "weekly", 10080, 600, "2023-01-01", 1, False, None, None, None, None),
    ("regimes", "regimes.json", "weekly", 10080, 60, "2023-01-01", 0, False, None, None, None, None),
]
_PREFIXES = {"factors": "zq-", "prices": "zq-", "scores": "zq-scores", "news": "zq-news", "feed": "zq-", "ticks": "zq-", "blind": "zq-", "regimes": "zq-regimes"}
_RECOVERY = {"regimes": "zq-", "absent": "nowhere-"}


def _prefixes(spark, of: dict):
    return spark.createDataFrame([(k, v, ".json") for k, v in of.items()], "artifact_id string, prefix string, suffix string")


def freshness_ladder(spark, sf):
    specs = spark.createDataFrame([r[:5] + (datetime.fromisoformat(r[5]).date(),) + r[6:] for r in _SPECS], freshness.SPEC)
    e = table(spark, sf, "run_executions")
    parts = []
    for now in _NOWS:
        seen = e.filter(F.col("stop_date") < F.lit(now).cast("timestamp_ntz"))
        objects = seen.select(F.concat(F.element_at(F.split("state_machine_arn", ":"), -1), F.lit("/"), "execution_name", F.lit(".json")).alias("key"), F.col("stop_date").cast("timestamp").alias("modified"))
        out = freshness.ladder(specs, lineage.newest_under(objects, _prefixes(spark, _PREFIXES)), lineage.newest_under(objects, _prefixes(spark, _RECOVERY)), datetime.fromisoformat(now))
        parts.append(out.select(F.lit(now).alias("as_of"), "artifact_id", "cadence", "expected_key", "dedup_key", "state", F.col("newest_at").cast("timestamp_ntz").alias("newest_at"), "recovered", "late_minutes"))
    return reduce(DataFrame.unionByName, parts)


def completeness(spark, sf):
    e = table(spark, sf, "run_executions")
    n = F.length("execution_arn") % 3
    kind = F.when(n == 0, "json_count_field").when(n == 1, "csv_row_count").otherwise("parquet_row_count")
    checks = e.select(F.col("execution_arn").alias("artifact_id"), kind.alias("kind"), F.lit("shards").alias("field"), F.lit(2).alias("min_count"))
    lines = F.concat(F.lit('"a\nb",c\n'), F.array_join(F.array_repeat(F.lit('1,"x"\n'), F.coalesce(F.col("redrive_count"), F.lit(0)).cast("int")), ""), F.when(F.col("status") == "SUCCEEDED", "2,y").otherwise(""))
    bodies = e.filter("status != 'RUNNING'").select(F.col("execution_arn").alias("artifact_id"), F.when(n == 0, F.col("input")).otherwise(lines).alias("body"), (F.col("redrive_count") + 1).alias("n_rows"))
    return freshness.completeness(checks, bodies)


def alert_decisions(spark, sf):
    p = table(spark, sf, "part")
    state = F.when(F.col("p_size") < 8, "missing").when(F.col("p_size") < 15, "stale").when(F.col("p_size") < 20, "probe_failed").when(F.col("p_size") < 25, "grace_period").otherwise("fresh")
    out = freshness.alert_decisions(p.select(F.col("p_partkey").alias("id"), state.alias("state")), _edges(spark, sf))
    return out.withColumn("roots", F.array_join("roots", ","))


def _deliverables(spark, sf):
    h = table(spark, sf, "run_history").filter("event_type is not null")
    return h.groupBy(F.col("state_machine_arn").alias("module"), F.col("event_type").alias("name")).agg(F.min("event_ts").alias("first"), F.count(F.lit(1)).alias("n"))


def module_status(spark, sf):
    d = _deliverables(spark, sf).select("module", "name", F.concat("module", F.lit("/"), "name").alias("key"), (F.length("name") % 2 == 0).alias("required"), (F.col("n") % 7 != 3).alias("produced"))
    listing = _deliverables(spark, sf).filter("n % 5 != 2").select(F.concat("module", F.lit("/"), "name").alias("key"), F.col("first").cast("timestamp").alias("modified"))
    checked = freshness.verified(d, listing, F.lit("2023-06-01 00:00:00").cast("timestamp"))
    e = table(spark, sf, "run_executions").groupBy(F.col("state_machine_arn").alias("module")).agg(F.max(F.when(F.col("status") == "FAILED", F.lit("failed"))).alias("error"), F.sum("redrive_count").alias("n_warnings"))
    out = freshness.module_status(checked, e)
    return out.withColumn("missing", F.array_join("missing", ","))


def stale_suppliers(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_suppkey % 3 != 0 or l_shipdate < '1998-06-01'").withColumn("d", F.to_date("l_shipdate"))
    return freshness.stale_symbols(li, "l_suppkey", "d", F.lit("1998-12-01").cast("date"), 25)


def _inventory(spark, sf):
    e = table(spark, sf, "run_executions")
    rows = e.select(F.col("execution_arn").alias("row_id"), F.when(F.col("redrive_count") > 0, "weekly").otherwise("daily").alias("cadence"), F.to_date("start_date").alias("effective_date"), (F.col("status") == "RUNNING").alias("gated"), (F.length("execution_name") % 9 == 0).alias("non_fatal"))
    sources = e.select(F.col("execution_arn").alias("row_id"), F.lit(0).alias("place"), F.concat(F.lit("in/"), "execution_arn", F.lit("/{date}.json")).alias("pattern"), F.lit(40).alias("max_age_days"))
    sources = sources.unionByName(sources.withColumns({"place": F.lit(1), "pattern": F.concat(F.lit("out/"), "row_id", F.lit("/{date}.json")), "max_age_days": F.lit(200)}))
    day = F.to_date("stop_date")
    objects = e.select(F.concat(F.lit("in/"), "execution_arn", F.lit("/"), day.cast("string"), F.lit(".json")).alias("key"), F.col("input").alias("body"))
    objects = objects.unionByName(e.select(F.concat(F.lit("out/"), "execution_arn", F.lit("/"), day.cast("string"), F.lit(".json")).alias("key"), F.to_json(F.struct(F.lit("weekly").alias("pipeline_role"), F.lower("status").alias("status"), F.col("redrive_count").alias("n"))).alias("body")))
    today = F.lit("2024-06-30").cast("date")
    found = inventory.resolved(sources, objects.filter("key is not null and body is not null"), today)
    first = inventory.check_json(found.filter("place = 0"), ["pipeline_role", "shards"], {}, [])
    second = inventory.check_json(found.filter("place = 1"), ["pipeline_role"], {"n": 1.0}, ["failed"], e.filter("length(execution_name) % 11 = 0").select(F.col("execution_arn").alias("row_id")))
    return inventory.check_inventory(inventory.rows_of(rows, "weekly"), first.unionByName(second), today)


def inventory_checks(spark, sf):
    return _inventory(spark, sf)


def inventory_report(spark, sf):
    return inventory.inventory_report(_inventory(spark, sf))


def inventory_tables(spark, sf):
    o = table(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")))
    sound = inventory.check_table(o, ["o_orderkey"], ["o_custkey"], latest=F.col("o_totalprice") > 0, order="o_orderkey")
    nulls = inventory.check_table(o, ["o_orderkey", "gone"], ["note", "lost"], ("o_orderdate", "1995-01-01"), F.col("o_orderpriority") == "1-URGENT")
    early = inventory.check_table(o, [], ["note"], ("o_orderdate", "2050-01-01"))
    return sound.withColumn("what", F.lit("sound")).unionByName(nulls.withColumn("what", F.lit("nulls"))).unionByName(early.withColumn("what", F.lit("early")))


def inventory_metric_checks(spark, sf):
    e = table(spark, sf, "run_executions").filter("start_date is not null")
    points = e.select(F.element_at(F.split("state_machine_arn", "-"), -1).alias("metric"), F.col("start_date").cast("timestamp").alias("at"), F.col("state_machine_arn").alias("dimension"), (F.col("status") == "SUCCEEDED").cast("int").alias("succeeded"), (F.col("status") == "FAILED").cast("int").alias("failed"))
    rows = [(f"{m}{op}", i, m, op, t, 700) for m in ("weekly", "audit", "eod", "none") for i, (op, t) in enumerate([("success_rate_pct_gte", 90.0), ("datapoints_gte", 3.0)])]
    wanted = spark.createDataFrame(rows, "row_id string, place int, metric string, op string, threshold double, window_days int")
    return inventory.check_metrics(wanted, points, F.lit("2024-12-31 00:00:00").cast("timestamp")).drop("degraded")


_QUERIES = [freshness_ladder, completeness, alert_decisions, module_status, stale_suppliers, inventory_checks, inventory_report, inventory_tables, inventory_metric_checks]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def _value(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()


def _ladder_sql() -> str:
    specs = ", ".join("(" + ", ".join(_value(v) for v in r) + ")" for r in _SPECS)
    pre = ", ".join(f"('{k}', '{v}')" for k, v in _PREFIXES.items())
    rec = ", ".join(f"('{k}', '{v}')" for k, v in _RECOVERY.items())
    nows = ", ".join(f"('{n}', timestamp '{n}', date '{f}', {'true' if f == '2024-06-10' else 'false'})" for n, f in _NOWS.items())
    return f"""with s(id, tmpl, c, em, sla, created, grace, aware, rc, a0, a1, err) as (values {specs}), w(as_of, n, fd, td) as (values {nows}), p(id, pre) as (values {pre}), q(id, pre) as (values {rec}),
o as (select split_part(state_machine_arn, ':', -1) || '/' k, stop_date t from run_executions where stop_date is not null and execution_name is not null),
nn as (select as_of, id, max(t) x from w, p, o where starts_with(k, pre) and t < n group by 1, 2), rr as (select as_of, id, max(t) x from w, q, o where starts_with(k, pre) and t < n group by 1, 2),
x as (select s.*, w.*, nn.x nx, rr.x rx, coalesce(rc, case when a0 is not null then 'market_hours' else 'all_days' end) cal, date_trunc('day', n) d,
case c when 'daily' then d + interval 13 hour when 'weekly' then timestamp '2024-06-08 09:00' + case when n > timestamp '2024-06-15 09:00' then interval 7 day else interval 0 day end when 'continuous' then time_bucket(interval 1 minute * em, n, timestamp '1970-01-01') else d end tick
from s, w left join nn on nn.as_of = w.as_of and nn.id = s.id left join rr on rr.as_of = w.as_of and rr.id = s.id),
y as (select *, case c when 'weekly' then case when td then '2024-W23' else '2024-W24' end when 'continuous' then 'continuous_' || em || 'm_' || (epoch(tick)::bigint // (em * 60)) when 'event_driven' then 'event_driven_' || tick::date else tick::date::varchar end label,
case when c = 'weekly' then n - interval 10 day when c = 'daily' or cal <> 'all_days' and em >= 1440 then fd::timestamp else n - interval 1 minute * (em + sla) end floor,
epoch(n - created::timestamp) < grace * case c when 'weekly' then 604800 when 'continuous' then em * 60 else 86400 end young, aware and c = 'daily' and not td holiday,
c = 'continuous' and cal <> 'all_days' and (not td or cal = 'market_hours' and a0 is not null and not (hour(n) >= a0 and hour(n) < a1)) idle,
case when nx is null then rx when rx is null then nx else greatest(nx, rx) end best from x),
z as (select *, case when c = 'event_driven' then 'fresh' when young then 'grace_period' when holiday then 'fresh' when idle then 'fresh' when err is not null then 'probe_failed' when best is null then 'missing' when best >= floor then 'fresh' else 'stale' end state,
not (c = 'event_driven' or young or holiday or idle or err is not null) probed from y)
select as_of, id artifact_id, c cadence, replace(replace(replace(tmpl, '{{date}}', tick::date::varchar), '{{trading_day}}', tick::date::varchar), '{{cycle_label}}', label) expected_key, 'freshness_' || id || '_' || label dedup_key, state,
case when state in ('fresh', 'stale') and probed then best end newest_at, coalesce(rx is not null and (nx is null or rx > nx) and probed and state = 'fresh', false) recovered,
(case state when 'missing' then greatest(0, (epoch(n)::bigint - (epoch(tick)::bigint + sla * 60)) // 60) when 'stale' then greatest(0, floor((epoch(floor)::bigint - floor(epoch(best))) / 60)) else 0 end)::bigint late_minutes from z"""


def oracle_sql() -> dict[str, str]:
    closure = f"{_EDGES}, s as (select p_partkey id, case when p_size < 8 then 'missing' when p_size < 15 then 'stale' when p_size < 20 then 'probe_failed' when p_size < 25 then 'grace_period' else 'fresh' end state from part)"
    inv = """e as (select *, stop_date::date d from run_executions), b as (select execution_arn id, 0 place, d, input body, 40 lim from e union all select execution_arn, 1, d, json_object('pipeline_role', 'weekly', 'status', lower(status), 'n', redrive_count)::varchar, 200 from e),
f as (select *, date '2024-06-30' - d age from b where d is not null and body is not null and d <= date '2024-06-30' and date '2024-06-30' - d <= lim),
a as (select e.execution_arn id, place from e, (values (0), (1)) p(place)),
j as (select a.id, a.place, body, age, f.id is null gone, json_valid(body) v from a left join f on f.id = a.id and f.place = a.place),
t as (select id, place, age, gone, place = 1 and v and coalesce(json_extract_string(body, '$.status') = 'failed', false) soft,
list_filter(case when not v then ['json parse error'] else [case when not coalesce(json_exists(body, '$.pipeline_role'), false) then 'missing key ''pipeline_role''' end, case when place = 0 and not coalesce(json_exists(body, '$.shards'), false) then 'missing key ''shards''' end,
case when place = 1 and not coalesce(try_cast(json_extract_string(body, '$.n') as double) >= 1.0, false) then 'n < 1.0' end] end, lambda m: m is not null) fails from j),
u as (select id, place, not gone and not soft and len(fails) = 0 ok0, not gone and soft soft, case when gone then 'missing' when soft then 'degraded' when len(fails) = 0 then 'ok (age=' || age || 'd)' else array_to_string(fails, '; ') end det0 from t),
g as (select u.*, place = 1 and det0 = 'missing' and length(execution_name) % 11 = 0 saved, e.start_date::date eff, redrive_count, status, execution_name from u join e on e.execution_arn = u.id),
h as (select id, any_value(eff) eff, any_value(redrive_count) rd, any_value(status) st, any_value(execution_name) en, bool_or(ok0 or saved) any_ok, bool_or(soft) soft, arg_min(case when saved then 'companion present' else det0 end, place) filter (where ok0 or saved) good, string_agg(case when saved then 'companion present' else det0 end, '; ' order by place) said from g group by 1),
r as (select id row_id, case when rd > 0 then 'weekly' else 'daily' end cadence, case when date '2024-06-30' < eff then 'not_yet_effective' when st = 'RUNNING' then 'gated' when any_ok then 'ok' when length(en) % 9 = 0 or soft then 'degraded' else 'fail' end status, good, said from h)"""
    return {
        "freshness_ladder": _ladder_sql(),
        "completeness": r"""with e as (select *, length(execution_arn) % 3 k from run_executions),
x as (select execution_arn artifact_id, case k when 0 then 'json_count_field' when 1 then 'csv_row_count' else 'parquet_row_count' end kind, case when status <> 'RUNNING' then case k
when 0 then case when json_valid(input) then case json_type(input, '$.shards') when 'ARRAY' then json_array_length(input, '$.shards')::int else try_cast(json_extract_string(input, '$.shards') as double)::int end end
when 1 then coalesce(redrive_count, 0)::int + case when status = 'SUCCEEDED' then 1 else 0 end else (redrive_count + 1)::int end end observed from e)
select artifact_id, kind, observed, case when observed is null then 'probe_failed' when observed < 2 then 'incomplete' else 'complete' end state from x""",
        "alert_decisions": f"""with recursive {closure}, g as (select id from s where state in ('missing', 'stale')), o as (select id from s where state not in ('fresh', 'grace_period')),
w as (select * from e where id in (from g) and depends_on in (from g)), rc as (select id, id root from g union select rc.id, w.depends_on from rc join w on w.id = rc.root), roots as (select * from rc where root not in (select id from w)),
bl as (select b.id, string_agg(distinct root::varchar, ',' order by root::varchar) roots0, list_sort(list_distinct(list(root))) roots from (select e.id, e.depends_on from e where e.id in (from o) and e.depends_on in (from g)) b join roots on roots.id = b.depends_on group by 1),
dn as (select id, id leaf from o where id not in (select id from bl) union select dn.id, e.id from dn join e on e.depends_on = dn.leaf),
lf as (select dn.id, count(*) filter (where s.state is null or s.state not in ('fresh', 'grace_period')) lost from dn left join s on s.id = dn.leaf where leaf not in (select depends_on from e) group by 1)
select s.id, case when state in ('fresh', 'grace_period') then 'ok' when bl.id is not null then 'blocked' when state = 'probe_failed' then 'degraded' else 'failed' end classification,
coalesce(case when bl.id is null and state not in ('fresh', 'grace_period') then lost end, 0) > 0 should_page,
case when state in ('fresh', 'grace_period') then '' when bl.id is not null then array_to_string(bl.roots, ',') else s.id::varchar end roots, coalesce(case when bl.id is null and state not in ('fresh', 'grace_period') then lost end, 0)::int lost
from s left join bl using (id) left join lf using (id)""",
        "module_status": """with d as (select state_machine_arn module, event_type name, min(event_ts) first, count(*) n from run_history where event_type is not null group by 1, 2),
c as (select module, name, length(name) % 2 = 0 required, n % 7 <> 3 and coalesce(n % 5 <> 2 and floor(epoch(first)) >= epoch(timestamp '2023-06-01') - 60, false) produced from d),
g as (select module, count(*) n, array_to_string(list_sort(list(name) filter (where required and not produced)), ',') missing, bool_or(not produced) anyone from c group by 1),
e as (select state_machine_arn module, max(case when status = 'FAILED' then 'failed' end) error, sum(redrive_count) w from run_executions group by 1)
select module, coalesce(n, 0) n_deliverables, coalesce(missing, '') missing, case when error is not null or coalesce(missing, '') <> '' then 'failed' when w > 0 or coalesce(anyone, false) then 'degraded' else 'ok' end status from e left join g using (module)""",
        "stale_suppliers": "with m as (select l_suppkey, max(l_shipdate)::date last_day from lineitem where l_suppkey % 3 <> 0 or l_shipdate < date '1998-06-01' group by 1) select l_suppkey, last_day, (date '1998-12-01' - last_day)::int age_days from m where date '1998-12-01' - last_day > 25",
        "inventory_checks": f"with {inv} select row_id, cadence, status, case when status = 'ok' then good when status in ('degraded', 'fail') then coalesce(said, '') else '' end detail from r",
        "inventory_report": f"""with {inv}, k as (select count(*) n, count(*) filter (where status = 'ok') ok, count(*) filter (where status = 'fail') fail, count(*) filter (where status = 'degraded') degraded, count(*) filter (where status = 'gated') gated, count(*) filter (where status = 'not_yet_effective') pending from r)
select *, case when n - pending - degraded - gated > 0 then round(100.0 * ok / (n - pending - degraded - gated), 2) end pct_ok from k""",
        "inventory_tables": """select true ok, count(*) n_rows, '' detail, 'sound' what from orders
union all select false, count(*), 'missing column ''gone''; missing column ''lost''' || case when count(*) filter (where o_orderdate::date > date '1995-01-01' and o_orderpriority = '1-URGENT' and o_orderkey % 50 = 0) > 0 then '; column ''note'' has null rows' else '' end, 'nulls' from orders
union all select true, count(*), '', 'early' from orders""",
        "inventory_metric_checks": """with p as (select split_part(state_machine_arn, '-', -1) metric, state_machine_arn dim, status from run_executions where start_date >= timestamp '2024-12-31' - interval 700 day and start_date <= timestamp '2024-12-31'),
w(metric, place, op, th) as (select m, i, op, th from (values ('weekly'), ('audit'), ('eod'), ('none')) a(m), (values (0, 'success_rate_pct_gte', 90.0), (1, 'datapoints_gte', 3.0)) b(i, op, th)),
d as (select metric, dim, count(*) n, count(*) filter (where status = 'SUCCEEDED') s, count(*) filter (where status = 'FAILED') f from p group by 1, 2),
g as (select metric, sum(n) n, min(case when s + f > 0 then 100.0 * s / (s + f) end) worst from d group by 1)
select metric || op row_id, place, coalesce(case op when 'datapoints_gte' then coalesce(n, 0) >= th else worst >= th end, false) ok, case when coalesce(case op when 'datapoints_gte' then coalesce(n, 0) >= th else worst >= th end, false) then 'ok' when coalesce(n, 0) = 0 then 'no data' else 'below threshold' end detail
from w left join g using (metric)""",
    }
