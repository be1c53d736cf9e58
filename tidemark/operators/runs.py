"""Run histories: entered states, tasks, failures, reliability, streaks, coverage.

Histories are numbered event rows.  The windows here only carry a row or a counter along a run in order, so a run's rows stream through
an external sort and are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def events_once(history: DataFrame, run: str, number: str, recorded: str) -> DataFrame:
    """One row per event: of an event delivered again, the first record.  Only keys and times are compared."""
    w = Window.partitionBy(run, number).orderBy(F.asc_nulls_last(recorded))
    return history.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def entered_states(events: DataFrame, run: str, number: str, state: Column) -> DataFrame:
    """(run, position, state): the states entered, in order, equal ones in a row collapsed; position from 1."""
    w = Window.partitionBy(run).orderBy(number)
    x = events.select(run, number, state.alias("state")).filter("state is not null")
    first = F.lag("state").over(w).isNull() | (F.lag("state").over(w) != F.col("state"))
    kept = x.withColumn("__new", first).filter("__new")
    return kept.select(run, F.row_number().over(w).alias("position"), "state")


def state_spans(events: DataFrame, run: str, number: str, ts: str, entered: Column, left: Column) -> DataFrame:
    """(run, state, n_entered, started, ended, status): first entry, last exit, 'running' where it was entered more often than left."""
    x = events.select(run, ts, entered.alias("i"), left.alias("o"))
    both = x.select(run, ts, F.explode(F.array(F.struct(F.col("i").alias("state"), F.lit(1).alias("d")), F.struct(F.col("o").alias("state"), F.lit(-1).alias("d")))).alias("x")).select(run, ts, "x.*").filter("state is not null")
    out = both.groupBy(run, "state").agg(F.count_if(F.col("d") == 1).alias("n_entered"), F.count_if(F.col("d") == -1).alias("n_left"), F.min(F.when(F.col("d") == 1, F.col(ts))).alias("started"), F.max(F.when(F.col("d") == -1, F.col(ts))).alias("ended"))
    return out.select(run, "state", "n_entered", "started", "ended", F.when(F.col("n_entered") > F.col("n_left"), "running").otherwise("done").alias("status"))


def failing_state(events: DataFrame, run: str, number: str, state: Column, failed: Column) -> DataFrame:
    """(run, failing_state): the state entered last before a run's first failure; null where none was.  Two aggregates, no window."""
    first = events.filter(failed).groupBy(run).agg(F.min(number).alias("__at"))
    x = events.select(run, number, state.alias("state")).filter("state is not null").join(first, run).filter(F.col(number) < F.col("__at"))
    return first.join(x.groupBy(run).agg(F.max_by("state", number).alias("failing_state")), run, "left").select(run, "failing_state")


def run_date(text: Column, name: Column, started: Column) -> Column:
    """A run's date: as its input tells, else as its name does, else the day it started."""
    told = F.try_to_date(F.get_json_object(text, "$.run_date"), "yyyy-MM-dd")
    named = F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    return F.coalesce(told, named, F.to_date(started))


def latest_runs(runs: DataFrame, machine: str, started: str, key: str, k: int) -> DataFrame:
    """The ``k`` latest runs per machine, ties by smaller key; each task hands on at most ``k`` per machine."""
    w = Window.partitionBy(machine).orderBy(F.desc(started), key)
    return runs.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= k)


def reliability(runs: DataFrame, machine: str, cycle: str, started: str, ok: Column, cause: Column) -> DataFrame:
    """Per machine and cycle: attempts, attempts_to_success, recovered, and how many of its failure causes are new or were seen in an earlier
    cycle."""
    w = Window.partitionBy(machine, cycle).orderBy(started)
    x = runs.select(machine, cycle, started, ok.alias("ok"), F.when(~ok, cause).alias("cause")).withColumn("attempt", F.row_number().over(w))
    per = x.groupBy(machine, cycle).agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("attempts_to_success"))
    causes = x.filter("cause is not null").select(machine, cycle, "cause").distinct()
    first = causes.groupBy(machine, "cause").agg(F.min(cycle).alias("__first"))
    known = causes.join(first, [machine, "cause"]).groupBy(machine, cycle).agg(F.count_if(F.col("__first") == F.col(cycle)).alias("new_causes"), F.count_if(F.col("__first") < F.col(cycle)).alias("repeated_causes"))
    out = per.join(known, [machine, cycle], "left")
    return out.select(machine, cycle, "attempts", "attempts_to_success", F.coalesce(F.col("attempts_to_success") > 1, F.lit(False)).alias("recovered"), F.coalesce("new_causes", F.lit(0)).alias("new_causes"), F.coalesce("repeated_causes", F.lit(0)).alias("repeated_causes"))


def clean_streak(cycles: DataFrame, machine: str, cycle: str, clean: Column) -> DataFrame:
    """Per machine: the number of clean cycles after the last that wasn't.  Two aggregates: the last unclean cycle, then a count after it."""
    last = cycles.groupBy(machine).agg(F.max(F.when(~clean, F.col(cycle))).alias("__last"))
    j = cycles.join(last, machine)
    return j.groupBy(machine).agg(F.count_if(F.col("__last").isNull() | (F.col(cycle) > F.col("__last"))).alias("clean_streak"))


def runs_of(rows: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """Gaps and islands: (by, value, first, last, length) of maximal runs of equal value in order; null is a value."""
    w = Window.partitionBy(*by).orderBy(order)
    x = rows.select(*by, order, value.alias("value"))
    new = F.row_number().over(w) == 1
    changed = new | ~F.col("value").eqNullSafe(F.lag("value").over(w))
    x = x.withColumn("__new", changed.cast("int")).withColumn("__island", F.sum("__new").over(w))
    return x.groupBy(*by, "__island", "value").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__island")


def coverage(declared: DataFrame, verdicts: DataFrame, entered: DataFrame, by: list[str]) -> DataFrame:
    """Per declared or judged (by): 'covered', 'finding', 'absent' (entered without verdict), 'not_entered', 'unmeasured' (judged without being
    declared)."""
    d = declared.select(*by).distinct().withColumn("d", F.lit(True))
    v = verdicts.groupBy(*by).agg(F.bool_or("finding").alias("finding")).withColumn("v", F.lit(True))
    e = entered.select(*by).distinct().withColumn("e", F.lit(True))
    j = d.join(v, by, "full_outer").join(e, by, "left")
    state = F.when(F.col("d").isNull(), "unmeasured").when(F.col("v") & F.col("finding"), "finding").when(F.col("v"), "covered").when(F.col("e"), "absent").otherwise("not_entered")
    return j.select(*by, state.alias("coverage"))


def depth(entered: DataFrame, run: str, state: str, spine: DataFrame) -> DataFrame:
    """(run, depth, deepest): the last stage of ``spine``(stage, place) that a run entered; null for runs that entered none.  The spine is a
    declared list of at most ``MAX_SPINE`` stages (checked) and is broadcast."""
    at = entered.join(F.broadcast(bounded(spine)).select(F.col("stage").alias(state), "place"), state, "left")
    return at.groupBy(run).agg(F.max("place").alias("depth"), F.max_by(state, F.col("place")).alias("deepest")).select(run, "depth", F.when(F.col("depth").isNotNull(), F.col("deepest")).alias("deepest"))


MAX_SPINE = 10_000


def bounded(spine: DataFrame) -> DataFrame:
    if spine.limit(MAX_SPINE + 1).count() > MAX_SPINE:
        raise ValueError(f"more than {MAX_SPINE} declared stages")
    return spine


def work_verdicts(runs: DataFrame, entered: DataFrame, spine: DataFrame, skips: DataFrame, run: str, machine: str, status: str) -> DataFrame:
    """(run, machine, verdict, reason, terminal, entered_stages, missing_stages) of ``runs``, by the states they ``entered``(run, position, state).

    'in_flight' while running, 'incomplete' (execution_failed); of those that succeeded 'skipped' where the last state is a declared one of
    ``skips``(machine, state), 'incomplete' without any stage of ``spine``(machine, stage, place) (vacuous_success) or without some
    (partial_success), else 'completed'.  A machine without spine fails the query."""
    seen = entered.groupBy(run).agg(F.max_by("state", "position").alias("terminal"), F.collect_set("state").alias("states"))
    declared = bounded(spine).groupBy(machine).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "stage"))), lambda x: x["stage"]).alias("spine"))
    off = skips.groupBy(machine).agg(F.collect_set("state").alias("skips"))
    x = runs.select(run, machine, status).join(F.broadcast(declared), machine, "left").join(F.broadcast(off), machine, "left").join(seen, run, "left")
    none = F.array().cast("array<string>")
    own = F.when(F.col("spine").isNull(), F.raise_error(F.lit("no stages declared for a machine")).cast("array<string>")).otherwise(F.col("spine"))
    states = F.coalesce("states", none)
    x = x.withColumn("entered_stages", F.filter(own, lambda s: F.array_contains(states, s))).withColumn("missing_stages", F.filter(own, lambda s: ~F.array_contains(states, s)))
    running, failed = F.col(status) == "RUNNING", F.col(status).isin("FAILED", "TIMED_OUT", "ABORTED")
    skipped = F.col("terminal").isNotNull() & F.array_contains(F.coalesce("skips", none), F.col("terminal"))
    reason = F.when(running, "still_running").when(failed, "execution_failed").when(F.coalesce(skipped, F.lit(False)), "declared_skip").when(F.size("entered_stages") == 0, "vacuous_success").when(F.size("missing_stages") > 0, "partial_success").otherwise("full_run")
    x = x.withColumn("reason", reason)
    verdict = F.when(F.col("reason") == "still_running", "in_flight").when(F.col("reason") == "declared_skip", "skipped").when(F.col("reason") == "full_run", "completed").otherwise("incomplete")
    return x.select(run, machine, verdict.alias("verdict"), "reason", "terminal", "entered_stages", "missing_stages")


# fixed values: roles of runs by what they stand for
ROLES = {"cadence": ("weekly", "weekday", "eod"), "recovery": ("watch-rerun", "recovery"), "exercise": ("exercise",), "adhoc": ("smoke", "shell-run", "backfill", "operator-replay")}


def role_bucket(role: Column) -> Column:
    """cadence, recovery, exercise or adhoc; null for none and for unknown ones."""
    return F.coalesce(*[F.when(role.isin(*names), F.lit(bucket)) for bucket, names in ROLES.items()])


def cadence_roles(role: str) -> tuple[str, ...]:
    """The roles that count for a cadence: its own and recoveries."""
    if role not in ROLES["cadence"]:
        raise ValueError(f"no such cadence role: {role}")
    return (role, *ROLES["recovery"])


def cycle_shapes(cycles: DataFrame, outcomes: DataFrame, spine: DataFrame, by: list[str], machine: str) -> DataFrame:
    """(by, verdict, reason, n_runs, missing_stages) of ``cycles``(by): the runs of ``outcomes``(by, role, verdict, entered_stages) of cadence and
    recovery roles, and those without one, taken together.

    'completed' where they entered every stage (recovered_across_executions with several), 'skipped' where all were, 'in_flight' where one
    is, else 'incomplete' (no_executions, partial_cycle)."""
    counted = outcomes.filter(F.col("role").isNull() | (F.col("role") == "") | role_bucket(F.col("role")).isin("cadence", "recovery"))
    stages = counted.select(*by, F.explode("entered_stages").alias("stage")).distinct().groupBy(*by).agg(F.collect_set("stage").alias("entered"))
    runs = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.bool_and(F.col("verdict") == "skipped").alias("all_skipped"), F.bool_or(F.col("verdict") == "in_flight").alias("running"))
    declared = bounded(spine).groupBy(machine).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "stage"))), lambda x: x["stage"]).alias("spine"))
    x = cycles.select(*by).distinct().join(runs, by, "left").join(stages, by, "left").join(F.broadcast(declared), machine, "left")
    missing = F.filter(F.coalesce("spine", F.array().cast("array<string>")), lambda s: ~F.array_contains(F.coalesce("entered", F.array().cast("array<string>")), s))
    x = x.withColumn("missing_stages", missing).withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
    reason = F.when(F.col("n_runs") == 0, "no_executions").when(F.size("missing_stages") == 0, F.when(F.col("n_runs") > 1, "recovered_across_executions").otherwise("full_cycle")).when(F.col("all_skipped"), "declared_skip").when(F.col("running"), "still_running").otherwise("partial_cycle")
    x = x.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isin("recovered_across_executions", "full_cycle"), "completed").when(F.col("reason") == "declared_skip", "skipped").when(F.col("reason") == "still_running", "in_flight").otherwise("incomplete")
    return x.select(*by, verdict.alias("verdict"), "reason", "n_runs", "missing_stages")


def fingerprint(failing_state: Column, error: Column, attempt: Column) -> Column:
    """state:error of a failure, or unresolved:attempt where either isn't known, which no other failure equals."""
    return F.coalesce(F.concat(failing_state, F.lit(":"), error), F.concat(F.lit("unresolved:"), attempt))


def cause_frequency(attempts: DataFrame, by: list[str], cause: str) -> DataFrame:
    """How often each resolved cause appeared."""
    return attempts.filter(F.col(cause).isNotNull() & ~F.startswith(cause, F.lit("unresolved:"))).groupBy(*by, cause).agg(F.count(F.lit(1)).alias("n"))


def looping(window: DataFrame, machine: str, cycle: str) -> DataFrame:
    """Per machine of ``window``(machine, cycle, settled, skip_only, attempts, repeated_causes): whether the last settled cycle that wasn't only
    skips met a cause of an earlier one; null where no cycle is settled."""
    counts = F.col("settled") & ~F.col("skip_only") & (F.col("attempts") > 0)
    return window.groupBy(machine).agg(F.max_by(F.col("repeated_causes") > 0, F.when(counts, F.col(cycle))).alias("looping"), F.bool_or(counts).alias("__any")).select(machine, F.when(F.col("__any"), F.col("looping")).alias("looping"))


def last_cycles(rows: DataFrame, machine: str, cycle: str, k: int) -> DataFrame:
    """``rows`` of the ``k`` latest cycles of each machine."""
    w = Window.partitionBy(machine).orderBy(F.desc(cycle))
    kept = rows.select(machine, cycle).filter(F.col(cycle).isNotNull()).distinct().withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")
    return rows.join(kept, [machine, cycle], "left_semi")


def wall_clock(runs: DataFrame, machine: str, cycle: str, started: str, stopped: str) -> DataFrame:
    """Per machine and cycle: the seconds of its runs added up, and of those that ended their number."""
    seconds = F.unix_micros(F.col(stopped).cast("timestamp")) / 1e6 - F.unix_micros(F.col(started).cast("timestamp")) / 1e6
    return runs.groupBy(machine, cycle).agg(F.round(F.sum(seconds), 3).alias("wall_clock_sec"), F.count(stopped).alias("n_ended"))


def pipeline_state(runs: DataFrame, entered: DataFrame, run: str, machine: str, started: str, status: str, role: Column, roles: tuple[str, ...] | None = None) -> DataFrame:
    """(machine, run, status, role, n_states, last_state): the latest run of each machine, of ``roles`` only if given."""
    x = runs.select(run, machine, started, status, role.alias("role"))
    if roles is not None:
        x = x.filter(F.col("role").isin(*roles))
    last = x.groupBy(machine).agg(F.max_by(F.struct(run, status, "role"), F.struct(started, run)).alias("r")).select(machine, "r.*")
    seen = entered.groupBy(run).agg(F.count(F.lit(1)).alias("n_states"), F.max_by("state", "position").alias("last_state"))
    return last.join(seen, run, "left").select(machine, run, status, "role", F.coalesce("n_states", F.lit(0)).alias("n_states"), "last_state")


def loaded_verdicts(documents: DataFrame) -> DataFrame:
    """(key, stage, status, readable) of verdict documents(key, body), JSON objects or such quoted in JSON once more."""
    once = F.try_parse_json("body")
    twice = F.coalesce(F.try_parse_json(F.try_variant_get(once, "$", "string")), once)
    x = documents.select("key", twice.alias("v"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return x.select("key", F.when(ok, F.try_variant_get("v", "$.stage", "string")).alias("stage"), F.when(ok, F.try_variant_get("v", "$.status", "string")).alias("status"), ok.alias("readable"))


_ORDER = ("absent", "finding", "unmeasured", "covered", "not_entered")


def alert_conditions(sweep: DataFrame, by: str, stage: str, coverage: str, known: Column, threshold: int = 0) -> DataFrame:
    """(by, conditions): why a coverage sweep alerts: 'denominator_unestablished', 'absent_verdicts=n', 'findings=n' beyond ``threshold``."""
    out = sweep.groupBy(by).agg(F.bool_and(known).alias("k"), F.count_if(F.col(coverage) == "absent").alias("a"), F.count_if(F.col(coverage) == "finding").alias("f"))
    tests = [F.when(~F.col("k"), "denominator_unestablished"), F.when(F.col("a") > 0, F.concat(F.lit("absent_verdicts="), "a")), F.when(F.col("f") > threshold, F.concat(F.lit("findings="), "f"))]
    return out.select(by, F.array_compact(F.array(*tests)).alias("conditions"))


def rendered(sweep: DataFrame, by: str, stage: str, coverage: str, entered_only: bool = False) -> DataFrame:
    """``sweep`` with line, its place in the report of its group: by severity, then stage."""
    rows = sweep.filter(F.col(coverage) != "not_entered") if entered_only else sweep
    severity = F.array_position(F.array(*map(F.lit, _ORDER)), F.col(coverage))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy(by).orderBy(severity, stage)))


def marker_verdict(marker: Column) -> Column:
    """The cycle's verdict in a completion marker, 'unknown' where it tells none."""
    return F.coalesce(F.nullif(F.get_json_object(marker, "$.cycle_verdict"), F.lit("")), F.lit("unknown"))
