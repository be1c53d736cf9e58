"""Freshness, completeness and dependency graphs of artifacts, over a listing table of objects and an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch


def cycle_tick(now: Column, cadence: Column, every_minutes: Column) -> Column:
    """The latest tick of a cadence at or before ``now`` (UTC): 'weekly' Saturday 09:00, 'daily' 13:00 on weekdays, 'continuous' the epoch's
    multiple of ``every_minutes``, 'event_driven' midnight; null for others."""
    day = F.to_date(now)
    at = lambda d, h: F.timestamp_add("HOUR", F.lit(h), d.cast("timestamp"))
    saturday = F.date_sub(day, F.pmod(F.weekday(day) + 2, F.lit(7)).cast("int"))
    weekly = F.when(now >= at(saturday, 9), at(saturday, 9)).otherwise(at(F.date_sub(saturday, 7), 9))
    back = F.when(F.weekday(day) > 4, F.weekday(day) - 4).when(now < at(day, 13), F.when(F.weekday(day) == 0, 3).otherwise(1)).otherwise(0)
    floor = F.timestamp_seconds(F.floor(F.unix_timestamp(now) / (every_minutes * 60)) * every_minutes * 60)
    return F.when(cadence == "weekly", weekly).when(cadence == "daily", at(F.date_sub(day, back.cast("int")), 13)).when(cadence == "continuous", floor).when(cadence == "event_driven", day.cast("timestamp"))


def cycle_label(tick: Column, cadence: Column, every_minutes: Column) -> Column:
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), tick), F.lit("-W"), F.lpad(F.weekofyear(tick).cast("string"), 2, "0"))
    stamp = F.concat(F.lit("continuous_"), every_minutes, F.lit("m_"), F.floor(F.unix_timestamp(tick) / (every_minutes * 60)))
    return F.when(cadence == "weekly", week).when(cadence == "continuous", stamp).when(cadence == "event_driven", F.concat(F.lit("event_driven_"), F.to_date(tick))).otherwise(F.to_date(tick).cast("string"))


MAX_PREFIXES = 10_000


def newest_under(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``prefixes``(artifact_id, prefix, suffix) with the newest object below each: (artifact_id, newest_key, newest_at); ties by larger key.

    Prefixes are a registry of at most ``MAX_PREFIXES`` (checked) and are broadcast; objects are aggregated on the map side."""
    if prefixes.limit(MAX_PREFIXES + 1).count() > MAX_PREFIXES:
        raise ValueError(f"more than {MAX_PREFIXES} prefixes in one listing")
    hit = objects.join(F.broadcast(prefixes), F.startswith("key", "prefix") & F.endswith("key", "suffix"))
    best = hit.groupBy("artifact_id").agg(F.max(F.struct("modified", "key")).alias("m"))
    return best.select("artifact_id", F.col("m.key").alias("newest_key"), F.col("m.modified").alias("newest_at"))


def freshness(specs: DataFrame, newest: DataFrame, now: Column) -> DataFrame:
    """``specs``(artifact_id, cadence, every_minutes, sla_minutes, max_age_minutes) with tick, label, age_minutes and state: 'fresh' (also what
    is event-driven), 'grace_period' within the SLA of a tick not yet served, 'missing', 'stale'."""
    j = specs.join(newest, "artifact_id", "left").withColumn("tick", cycle_tick(now, F.col("cadence"), F.col("every_minutes")))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("newest_at")) / 60)
    since = (F.unix_timestamp(now) - F.unix_timestamp("tick")) / 60
    ok = age <= F.col("max_age_minutes")
    state = F.when(F.col("cadence") == "event_driven", "fresh").when(F.coalesce(ok, F.lit(False)), "fresh").when(since < F.col("sla_minutes"), "grace_period").when(F.col("newest_at").isNull(), "missing").otherwise("stale")
    return j.select("artifact_id", "cadence", "tick", cycle_label(F.col("tick"), F.col("cadence"), F.col("every_minutes")).alias("label"), age.alias("age_minutes"), state.alias("state"))


def cycle_completion(results: DataFrame, cycle: str) -> DataFrame:
    """Per cycle over (critical, state): 'incomplete' if a critical artifact is missing or stale, else 'indeterminate' if one couldn't be
    probed, else 'complete'."""
    bad = F.bool_or(F.col("critical") & F.col("state").isin("missing", "stale"))
    unknown = F.bool_or(F.col("critical") & (F.col("state") == "probe_failed"))
    out = results.groupBy(cycle).agg(F.count_if("critical").alias("n_critical"), F.coalesce(bad, F.lit(False)).alias("b"), F.coalesce(unknown, F.lit(False)).alias("u"))
    return out.select(cycle, "n_critical", F.when(F.col("b"), "incomplete").when(F.col("u"), "indeterminate").otherwise("complete").alias("verdict"))


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, node): repeated ids, and dependencies on what isn't there, of nodes(id) and edges(id, depends_on)."""
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate").alias("fault"), F.col("id").alias("node"))
    ends = edges.select(F.col("depends_on").alias("id")).union(edges.select("id")).distinct()
    dangling = ends.join(nodes.select("id").distinct(), "id", "left_anti").select(F.lit("dangling").alias("fault"), F.col("id").alias("node"))
    return twice.union(dangling)


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges left after sources and sinks have been peeled off until none is left: those on cycles or between them; empty for a DAG.

    The rounds are at most the longest path; each works on what is left and is written to the shared folder."""
    s = Scratch(edges.sparkSession, "cycles")
    left = s.write(edges.select("id", "depends_on").distinct(), "edges")
    n = left.count()
    while n:
        ids, deps = left.select("id").distinct(), left.select(F.col("depends_on").alias("id")).distinct()
        both = ids.join(deps, "id", "left_semi")
        kept = left.join(both, "id", "left_semi").join(both.withColumnRenamed("id", "depends_on"), "depends_on", "left_semi").select("id", "depends_on")
        kept = s.write(kept, "edges")
        s.drop(left)
        left, now = kept, kept.count()
        if now == n:
            return left
        n = now
    return left


def reachable(edges: DataFrame, start: str, end: str, starts: DataFrame | None = None) -> DataFrame:
    """(start, end, distance) for all pairs joined by a path of edges(start, end), the shortest counted, or for those of ``starts``(start) only;
    the closure's size is that of its result.  Semi-naive: a round extends only the pairs the last one found, so cycles end too."""
    s = Scratch(edges.sparkSession, "closure")
    e = s.write(edges.select(F.col(start).alias("a"), F.col(end).alias("b")).filter("a is not null and b is not null").distinct(), "edges")
    first = e if starts is None else e.join(starts.select(F.col(start).alias("a")).distinct(), "a", "left_semi")
    parts = [s.write(first.withColumn("distance", F.lit(1)), "pairs")]
    step = 1
    while True:
        step += 1
        hop = parts[-1].select("a", F.col("b").alias("via")).join(e.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        seen = reduce(DataFrame.unionByName, [p.select("a", "b") for p in parts])
        new = s.write(hop.join(seen, ["a", "b"], "left_anti").withColumn("distance", F.lit(step)), "pairs")
        if new.isEmpty():
            break
        parts.append(new)
    return reduce(DataFrame.unionByName, parts).select(F.col("a").alias(start), F.col("b").alias(end), "distance")


def reachable_leaves(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, leaf): what nothing depends on, downstream of each node of edges(id, depends_on), or of those of ``of``(id) only."""
    down = reachable(edges.select(F.col("depends_on").alias("id"), F.col("id").alias("leaf")), "id", "leaf", of)
    inner = edges.select(F.col("depends_on").alias("leaf")).distinct()
    return down.join(inner, "leaf", "left_anti").select("id", "leaf")


def root_causes(edges: DataFrame, gaps: DataFrame) -> DataFrame:
    """(id, root): for each gap of gaps(id) its deepest ancestors reached through gaps alone, itself where it has no gap above."""
    g = gaps.select("id").distinct()
    within = edges.join(g, "id", "left_semi").join(g.withColumnRenamed("id", "depends_on"), "depends_on", "left_semi")
    up = reachable(within.select("id", F.col("depends_on").alias("root")), "id", "root").select("id", "root").unionByName(g.select("id", F.col("id").alias("root")))
    return up.join(within.select(F.col("id").alias("root")).distinct(), "root", "left_anti").select("id", "root")


def windowed_artifact(objects: DataFrame, asked: DataFrame, max_age_days: int) -> DataFrame:
    """``asked``(run_date) with the newest of ``objects``(source_date, key) at or before it, no older than ``max_age_days``: key, source_date,
    age_days, null where there is none; ties by larger key.  Objects are reduced to one per day, days explode only over the asked window."""
    daily = objects.groupBy("source_date").agg(F.max("key").alias("key"))
    days = asked.select("run_date").distinct().select("run_date", F.explode(F.sequence(F.date_sub("run_date", max_age_days), F.col("run_date"))).alias("source_date"))
    best = days.join(daily, "source_date").groupBy("run_date").agg(F.max(F.struct("source_date", "key")).alias("m"))
    return asked.join(best, "run_date", "left").select("run_date", F.col("m.key").alias("key"), F.col("m.source_date").alias("source_date"), F.datediff("run_date", "m.source_date").alias("age_days"))


def fallback_dates(asked: DataFrame, max_days: int = 5) -> DataFrame:
    """(run_date, candidate, priority): the day itself, then the weekdays before it within ``max_days`` calendar days."""
    x = asked.select("run_date", F.posexplode(F.sequence(F.col("run_date"), F.date_sub("run_date", max_days), F.expr("interval -1 day"))).alias("priority", "candidate"))
    return x.filter("priority = 0 or weekday(candidate) < 5").select("run_date", "candidate", "priority")


def module_health(runs: DataFrame, modules: DataFrame, now: Column, max_age_hours: int = 48) -> DataFrame:
    """``modules``(module) with the status and age of the last of ``runs``(module, finished, status): missing is unknown, age -1, stale."""
    last = runs.filter("finished is not null").groupBy("module").agg(F.max(F.struct("finished", "status")).alias("m"))
    j = modules.join(last, "module", "left")
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("m.finished").cast("timestamp"))) / 3600
    return j.select("module", F.coalesce("m.status", F.lit("unknown")).alias("status"), F.coalesce(F.round(age, 2), F.lit(-1.0)).alias("age_hours"), F.coalesce(age > max_age_hours, F.lit(True)).alias("stale"))


def success_rate(rows: DataFrame, by: list[str], ok: Column, threshold: float) -> DataFrame:
    """Per group: successes in percent of all, and whether that reaches ``threshold``."""
    out = rows.groupBy(*by).agg(F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n"))
    rate = 100 * F.col("n_ok") / F.col("n")
    return out.select(*by, "n_ok", "n", F.round(rate, 6).alias("rate"), (rate >= threshold).alias("passed"))
