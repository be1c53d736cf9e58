"""The freshness ladder of artifacts, their completeness, alert decisions, and the health of modules by their deliverables.

Specifications are a registry table, one row per artifact; object listings are reduced to the newest object per artifact before they meet it.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import holidays
from tidemark.operators.lineage import cycle_label, cycle_tick, reachable_leaves, root_causes

SATISFIED = ("fresh", "grace_period")
GAPS = ("missing", "stale")

#: the columns of a specification
SPEC = (
    "artifact_id string, key_template string, cadence string, every_minutes int, sla_minutes int, created_on date, grace_cycles int, calendar_aware boolean, "
    "run_calendar string, active_from int, active_until int, probe_error string"
)


def is_trading_day(d: date) -> bool:
    return d.weekday() < 5 and d not in set(holidays(d.year, d.year))


def previous_trading_day(d: date) -> date:
    d -= timedelta(1)
    while not is_trading_day(d):
        d -= timedelta(1)
    return d


def last_closed_trading_day(now: datetime) -> date:
    """The last day whose session has ended (16:00 in New York) at ``now``, UTC."""
    local = now.replace(tzinfo=UTC).astimezone(ZoneInfo("America/New_York"))
    return local.date() if is_trading_day(local.date()) and local.hour >= 16 else previous_trading_day(local.date())


def cycle_seconds(cadence: Column, every_minutes: Column) -> Column:
    return F.when(cadence == "weekly", 7 * 86400).when(cadence == "continuous", every_minutes * 60).otherwise(86400)


def formatted_key(template: Column, label: Column, tick: Column) -> Column:
    """``template`` with {date}, {trading_day} and {cycle_label} filled in."""
    day = F.to_date(tick).cast("string")
    return F.replace(F.replace(F.replace(template, F.lit("{date}"), day), F.lit("{trading_day}"), day), F.lit("{cycle_label}"), label)


def dedup_key(artifact_id: Column, label: Column) -> Column:
    """One alert per artifact and cycle."""
    return F.concat(F.lit("freshness_"), artifact_id, F.lit("_"), label)


def ladder(specs: DataFrame, newest: DataFrame, recovery: DataFrame, now: datetime) -> DataFrame:
    """``specs`` (``SPEC``) at ``now`` (UTC): (artifact_id, cadence, expected_key, dedup_key, state, newest_at, recovered, late_minutes).

    The first that holds: event-driven is fresh; within its first ``grace_cycles`` cycles grace_period; a calendar-aware daily one whose
    tick is no trading day is fresh; so is a continuous one outside its run calendar ('trading_days', 'market_hours' with its active hours;
    'all_days' where nothing is said); one that couldn't be probed probe_failed; without object missing, late since tick and SLA; fresh if
    the newest object, or a newer recovery one, isn't older than the floor; else stale.
    The floor: weekly ten days ago; daily, and continuous by a run calendar once a day or less often, the start of the trading day before
    the last closed one; other continuous ones an interval and the SLA ago."""
    at = F.lit(now).cast("timestamp")
    floor_day = F.lit(previous_trading_day(last_closed_trading_day(now))).cast("timestamp")
    n = newest.select("artifact_id", F.col("newest_at").alias("n"))
    r = recovery.select("artifact_id", F.col("newest_at").alias("r"))
    x = specs.join(n, "artifact_id", "left").join(r, "artifact_id", "left")
    c, every = F.col("cadence"), F.col("every_minutes")
    x = x.withColumn("tick", cycle_tick(at, c, every)).withColumn("label", cycle_label(F.col("tick"), c, every))
    calendar = F.coalesce("run_calendar", F.when(F.col("active_from").isNotNull(), "market_hours").otherwise("all_days"))
    outside = (calendar == "market_hours") & F.col("active_from").isNotNull() & ~((F.lit(now.hour) >= F.col("active_from")) & (F.lit(now.hour) < F.col("active_until")))
    idle = (c == "continuous") & (calendar != "all_days") & (F.lit(not is_trading_day(now.date())) | outside)
    closed = [d for d in holidays(now.year - 1, now.year + 1)]
    tick_day = F.to_date("tick")
    holiday = F.col("calendar_aware") & (c == "daily") & ((F.weekday(tick_day) > 4) | tick_day.isin(closed))
    ago = lambda minutes: F.timestamp_seconds(F.unix_timestamp(at) - minutes * 60)
    floor = F.when(c == "weekly", ago(F.lit(10 * 1440))).when((c == "daily") | ((calendar != "all_days") & (every >= 1440)), floor_day).otherwise(ago(every + F.col("sla_minutes")))
    best = F.greatest("n", "r")
    young = F.unix_timestamp(at) - F.unix_timestamp(F.col("created_on").cast("timestamp")) < F.col("grace_cycles") * cycle_seconds(c, every)
    state = (
        F.when(c == "event_driven", "fresh").when(young, "grace_period").when(holiday, "fresh").when(idle, "fresh").when(F.col("probe_error").isNotNull(), "probe_failed")
        .when(best.isNull(), "missing").when(best >= floor, "fresh").otherwise("stale")
    )
    x = x.withColumn("state", state).withColumn("best", best).withColumn("floor", floor)
    minutes = lambda a, b: F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 60))
    deadline = F.timestamp_seconds(F.unix_timestamp("tick") + F.col("sla_minutes") * 60)
    late = F.when(F.col("state") == "missing", minutes(at, deadline)).when(F.col("state") == "stale", minutes(F.col("floor"), F.col("best"))).otherwise(0)
    probed = ~((c == "event_driven") | young | holiday | idle | F.col("probe_error").isNotNull())
    recovered = F.coalesce(F.col("r").isNotNull() & (F.col("n").isNull() | (F.col("r") > F.col("n"))), F.lit(False)) & F.coalesce(probed, F.lit(True)) & F.col("state").isin("fresh")
    return x.select("artifact_id", "cadence", formatted_key(F.col("key_template"), F.col("label"), F.col("tick")).alias("expected_key"), dedup_key(F.col("artifact_id"), F.col("label")).alias("dedup_key"), "state", F.when(F.col("state").isin("fresh", "stale") & probed, F.col("best")).alias("newest_at"), recovered.alias("recovered"), late.alias("late_minutes"))


def observed_count(kind: Column, body: Column, field: Column, n_rows: Column) -> Column:
    """How many rows an artifact holds: 'json_count_field' the number in a member, or the length of the array there; 'csv_row_count' the lines
    below the header, line breaks in quotes aside; 'parquet_row_count' the rows its footer tells.  Null where it can't be told."""
    member = F.call_function("get_json_object", body, F.concat(F.lit("$."), field))
    size = F.coalesce(F.json_array_length(member), F.floor(member.try_cast("double")).cast("bigint").cast("int"))
    bare = F.regexp_replace(F.regexp_replace(body, '"(?:[^"]|"")*"', ""), r"(?:\r\n|\n|\r)$", "")
    lines = F.when(F.length(body) == 0, 0).otherwise(F.size(F.split(bare, r"\r\n|\n|\r")) - 1)
    return F.when(kind == "json_count_field", size).when((kind == "csv_row_count") & body.isNotNull(), F.greatest(lines, F.lit(0))).when(kind == "parquet_row_count", n_rows.cast("int"))


def completeness(checks: DataFrame, bodies: DataFrame) -> DataFrame:
    """``checks``(artifact_id, kind, field, min_count) against ``bodies``(artifact_id, body, n_rows): (artifact_id, kind, observed, state), state
    'complete', 'incomplete' or 'probe_failed' (no body, or what doesn't tell a count)."""
    x = checks.join(bodies, "artifact_id", "left").withColumn("observed", observed_count(F.col("kind"), F.col("body"), F.col("field"), F.col("n_rows")))
    state = F.when(F.col("observed").isNull(), "probe_failed").when(F.col("observed") < F.col("min_count"), "incomplete").otherwise("complete")
    return x.select("artifact_id", "kind", "observed", state.alias("state"))


def alert_decisions(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Who is to be called for ``results``(id, state) with edges(id, depends_on): (id, classification, should_page, roots, lost).

    Satisfied is 'ok'.  Below a confirmed gap (missing, stale) it is 'blocked' and silent; roots are the gaps that cause it.  Else it is its
    own root, 'degraded' if it couldn't be probed and 'failed' otherwise, and pages if a deliverable downstream (itself where it is one)
    isn't satisfied; lost counts those.  Only nodes that aren't satisfied are walked from."""
    r = results.select("id", "state")
    gap = r.filter(F.col("state").isin(*GAPS)).select("id")
    open_ = r.filter(~F.col("state").isin(*SATISFIED))
    blockers = edges.join(open_.select("id"), "id", "left_semi").join(gap.withColumnRenamed("id", "depends_on"), "depends_on", "left_semi").select("id", "depends_on")
    causes = root_causes(edges, gap).select(F.col("id").alias("depends_on"), "root")
    blocked = blockers.join(causes, "depends_on").groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    root = open_.join(blocked.select("id"), "id", "left_anti")
    leaves = reachable_leaves(edges, root.select("id"))
    own = root.select("id", F.col("id").alias("leaf")).join(edges.select(F.col("depends_on").alias("id")).distinct(), "id", "left_anti")
    ends = leaves.unionByName(own).join(r.select(F.col("id").alias("leaf"), F.col("state").alias("at_end")), "leaf", "left")
    lost = ends.groupBy("id").agg(F.count_if(~F.coalesce(F.col("at_end").isin(*SATISFIED), F.lit(False))).alias("lost"))
    x = r.join(blocked, "id", "left").join(lost, "id", "left")
    ok, is_blocked = F.col("state").isin(*SATISFIED), F.col("roots").isNotNull()
    kind = F.when(ok, "ok").when(is_blocked, "blocked").when(F.col("state") == "probe_failed", "degraded").otherwise("failed")
    none = F.array().cast("array<" + results.schema["id"].dataType.simpleString() + ">")
    n_lost = F.when(ok | is_blocked, 0).otherwise(F.coalesce("lost", F.lit(0)))
    return x.select("id", kind.alias("classification"), (n_lost > 0).alias("should_page"), F.when(ok, none).when(is_blocked, F.col("roots")).otherwise(F.array("id")).alias("roots"), n_lost.cast("int").alias("lost"))


def verified(deliverables: DataFrame, listing: DataFrame, since: Column, slack_seconds: int = 60) -> DataFrame:
    """``deliverables``(module, name, key, required, produced) with produced taken back where the object isn't in ``listing``(key, modified) or
    is older than ``since`` less the slack; what has no key is believed."""
    last = listing.groupBy("key").agg(F.max("modified").alias("__m"))
    x = deliverables.join(last, "key", "left")
    there = F.col("key").isNull() | F.coalesce(F.unix_timestamp("__m") >= F.unix_timestamp(since) - slack_seconds, F.lit(False))
    return x.withColumn("produced", F.col("produced") & there).select(*deliverables.columns)


def missing_required(deliverables: DataFrame) -> DataFrame:
    return deliverables.filter("required and not produced").select("module", "name")


def module_status(deliverables: DataFrame, runs: DataFrame) -> DataFrame:
    """Per module of ``runs``(module, error, n_warnings): n_deliverables, missing (sorted names), status: 'failed' with an error or something
    required missing, 'degraded' with warnings or anything not produced, else 'ok'."""
    d = deliverables.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("required") & ~F.col("produced"), F.col("name")))).alias("missing"), F.bool_or(~F.col("produced")).alias("some"))
    x = runs.join(d, "module", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    status = F.when(F.col("error").isNotNull() | (F.size("missing") > 0), "failed").when((F.col("n_warnings") > 0) | F.coalesce("some", F.lit(False)), "degraded").otherwise("ok")
    return x.select("module", F.coalesce("n", F.lit(0)).alias("n_deliverables"), "missing", status.alias("status"))


def health_payloads(status: DataFrame, run_date: str) -> DataFrame:
    """(module, payload): one JSON document per module."""
    return status.select("module", F.to_json(F.struct("module", F.lit(run_date).alias("run_date"), "status", "n_deliverables", "missing")).alias("payload"))


def stale_symbols(rows: DataFrame, symbol: str, day: str, as_of: Column, max_days: int) -> DataFrame:
    """(symbol, last_day, age_days) of the symbols whose last day is older than ``max_days``, oldest first; symbols without any day come first."""
    out = rows.groupBy(symbol).agg(F.max(day).alias("last_day")).withColumn("age_days", F.datediff(as_of, "last_day"))
    return out.filter(F.col("age_days").isNull() | (F.col("age_days") > max_days)).orderBy(F.asc_nulls_first("last_day"), symbol)


def require_fresh(rows: DataFrame, symbol: str, day: str, as_of: Column, max_days: int) -> None:
    """Fails, naming ten of them, if any symbol is stale, and if there is no row at all."""
    if rows.isEmpty():
        raise RuntimeError("there is nothing to be fresh")
    found = stale_symbols(rows, symbol, day, as_of, max_days).limit(10).collect()
    if found:
        raise RuntimeError("stale: " + ", ".join(f"{r[0]} ({r.last_day})" for r in found))


def require_object(listing: DataFrame, key: str, as_of: Column, max_days: int | None = None) -> None:
    """Fails if there is no object ``key``, or none of at most ``max_days`` whole days."""
    age = listing.filter(F.col("key") == key).agg(F.min(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("modified")) / 86400))).first()[0]
    if age is None or (max_days is not None and age > max_days):
        raise RuntimeError(f"{key} is " + ("not there" if age is None else f"{age} days old"))


SEVERITIES = ("info", "warning", "error", "critical")


def gate_alerts(failures: DataFrame, layer: str, severity: str = "error") -> DataFrame:
    """The alert rows (layer, series, detail, severity) of failed gates(series, detail), to be appended to a table."""
    if severity not in SEVERITIES:
        raise ValueError(f"no such severity: {severity}")
    return failures.select(F.lit(layer).alias("layer"), "series", "detail", F.lit(severity).alias("severity"))


def guarded(verdicts: DataFrame, enforce: bool) -> DataFrame:
    """``verdicts``(check, passed, message) with action 'pass' or 'report'; in enforcement a failing verdict fails the query."""
    report = F.when(F.lit(enforce), F.raise_error(F.coalesce("message", F.lit("a guard failed"))).cast("string")).otherwise("report")
    return verdicts.withColumn("action", F.when(F.coalesce("passed", F.lit(False)), "pass").otherwise(report))
