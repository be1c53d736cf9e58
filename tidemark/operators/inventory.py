"""Declarative checks of an inventory: which artifacts should be there, how old, and what they should say.

An inventory is a table of rows (row_id, cadence, effective_date, gated, non_fatal) and one of sources in their order.  Every kind of source is
evaluated for all of its rows at once, to (row_id, place, ok, degraded, detail), and a row takes its first source that is ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CADENCES = {"weekly": ("weekly", "daily"), "daily": ("daily",), "per_event": ("per_event",)}


def rows_of(inventory: DataFrame, cadence: str) -> DataFrame:
    """The rows that a run of ``cadence`` checks: a weekly run the daily ones too."""
    if cadence not in CADENCES:
        raise ValueError(f"no such cadence: {cadence}")
    return inventory.filter(F.col("cadence").isin(*CADENCES[cadence]))


def resolved(sources: DataFrame, objects: DataFrame, today: Column) -> DataFrame:
    """``sources``(row_id, place, pattern, max_age_days) with the newest of ``objects``(key, day, body) that their pattern, {date} filled in,
    names within ``max_age_days`` before ``today``: key, age_days, body; null where there is none.  Days explode over the asked window only."""
    days = sources.select("row_id", "place", "pattern", F.explode(F.sequence(F.lit(0), F.col("max_age_days"))).alias("age_days"))
    named = days.withColumn("key", F.replace("pattern", F.lit("{date}"), F.date_sub(today, F.col("age_days")).cast("string")))
    found = named.join(objects.select("key", "body"), "key").groupBy("row_id", "place").agg(F.min_by(F.struct("key", "age_days", "body"), "age_days").alias("f"))
    return sources.join(found, ["row_id", "place"], "left").select(*sources.columns, "f.key", "f.age_days", "f.body")


def _failures(*tests: tuple[Column, str]) -> Column:
    """The messages of the tests that don't hold; a null test doesn't."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in tests]))


def _verdict(df: DataFrame, failures: Column, degraded: Column | None = None) -> DataFrame:
    absent = F.col("key").isNull()
    soft = F.lit(False) if degraded is None else F.coalesce(degraded, F.lit(False))
    detail = F.when(absent, "missing").when(soft, "degraded").otherwise(F.array_join(failures, "; "))
    ok = ~absent & ~soft & (F.size(failures) == 0)
    return df.select("row_id", "place", ok.alias("ok"), (~absent & soft).alias("degraded"), F.when(ok, F.concat(F.lit("ok (age="), "age_days", F.lit("d)"))).otherwise(detail).alias("detail"))


def check_json(found: DataFrame, required: list[str], minimum: dict[str, float], soft_statuses: list[str], companions: DataFrame | None = None) -> DataFrame:
    """Verdicts of JSON documents: members that must be there, numbers at paths that must reach a value, statuses of the producer that only
    degrade.  A missing document whose row is in ``companions``(row_id) is ok."""
    v = F.try_parse_json("body")
    number = lambda p: F.get_json_object("body", f"$.{p}").try_cast("double")
    tests = [(F.try_variant_get(v, f"$.{k}", "variant").isNotNull(), f"missing key '{k}'") for k in required] + [(number(p) >= x, f"{p} < {x}") for p, x in minimum.items()]
    failures = F.when(v.isNull(), F.array(F.lit("json parse error"))).otherwise(_failures(*tests))
    out = _verdict(found, failures, F.get_json_object("body", "$.status").isin(*soft_statuses) if soft_statuses else None)
    if companions is None:
        return out
    beside = out.join(companions.select("row_id", F.lit(True).alias("__c")).distinct(), "row_id", "left")
    saved = F.coalesce(F.col("__c") & (F.col("detail") == "missing"), F.lit(False))
    return beside.select("row_id", "place", (F.col("ok") | saved).alias("ok"), "degraded", F.when(saved, "companion present").otherwise(F.col("detail")).alias("detail"))


def check_table(rows: DataFrame, required: list[str], non_null: list[str], after: tuple[str, str] | None = None, only: Column | None = None, order: str | None = None, latest: Column | None = None) -> DataFrame:
    """One row (ok, n_rows, detail) for a table read from CSV or Parquet: columns that must be there, columns without nulls (of the rows whose
    ``after`` = (date column, day) is later and for which ``only`` holds), and a condition on the row that comes last by ``order``."""
    gone = [c for c in required if c not in rows.columns]
    lost = [c for c in non_null if c not in rows.columns]
    checked = F.lit(True)
    if after:
        checked = checked & (F.col(after[0]).cast("date") > F.lit(after[1]).cast("date"))
    if only is not None:
        checked = checked & only
    nulls = {c: F.count_if(F.coalesce(checked, F.lit(False)) & F.col(c).isNull()).alias(f"n_{c}") for c in non_null if c not in lost}
    last = [F.max_by(latest, order).alias("last")] if latest is not None and order else []
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), *nulls.values(), *last)
    tests = [(F.lit(False), f"missing column '{c}'") for c in dict.fromkeys(gone + lost)] + [(F.col(f"n_{c}") == 0, f"column '{c}' has null rows") for c in nulls]
    if last:
        tests.append((F.col("last"), "the latest row fails"))
    failures = _failures(*tests)
    return out.select((F.size(failures) == 0).alias("ok"), "n_rows", F.array_join(failures, "; ").alias("detail"))


def check_catalog(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``(row_id, place, table, column) against a ``catalog``(table, column) of what a database holds: a row's verdict."""
    there = wanted.join(catalog.select("table", "column", F.lit(True).alias("c")).distinct(), ["table", "column"], "left").join(catalog.select("table", F.lit(True).alias("t")).distinct(), "table", "left")
    lack = F.array_sort(F.collect_set(F.when(F.col("c").isNull(), F.concat(F.lit("missing column '"), "column", F.lit("'")))))
    out = there.groupBy("row_id", "place").agg(F.bool_and(F.col("t").isNotNull()).alias("t"), lack.alias("lack"))
    ok = F.col("t") & (F.size("lack") == 0)
    return out.select("row_id", "place", ok.alias("ok"), F.lit(False).alias("degraded"), F.when(ok, "ok").when(~F.col("t"), "table missing").otherwise(F.array_join("lack", "; ")).alias("detail"))


def check_metrics(wanted: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """``wanted``(row_id, place, metric, op, threshold, window_days) over ``points``(metric, at, dimension, succeeded, failed): op
    'success_rate_pct_gte' asks 100 * succeeded / all of every dimension with data (no data fails), 'datapoints_gte' the number of points."""
    start = F.unix_timestamp(now) - F.col("window_days") * 86400
    j = wanted.join(points, "metric", "left").withColumn("inside", F.coalesce((F.unix_timestamp("at") >= start) & (F.col("at") <= now), F.lit(False)))
    per = j.groupBy("row_id", "place", "op", "threshold", "dimension").agg(F.count_if("inside").alias("n"), F.sum(F.when(F.col("inside"), F.col("succeeded"))).alias("s"), F.sum(F.when(F.col("inside"), F.col("failed"))).alias("f"))
    rate = 100.0 * F.col("s") / F.when(F.col("s") + F.col("f") > 0, F.col("s") + F.col("f"))
    out = per.groupBy("row_id", "place", "op", "threshold").agg(F.sum("n").alias("n"), F.min(rate).alias("worst"))
    ok = F.coalesce(F.when(F.col("op") == "success_rate_pct_gte", F.col("worst") >= F.col("threshold")).when(F.col("op") == "datapoints_gte", F.col("n") >= F.col("threshold")), F.lit(False))
    return out.select("row_id", "place", ok.alias("ok"), F.lit(False).alias("degraded"), F.when(ok, "ok").when(F.col("n") == 0, "no data").otherwise("below threshold").alias("detail"))


def check_inventory(rows: DataFrame, verdicts: DataFrame, today: Column) -> DataFrame:
    """(row_id, cadence, status, detail): 'not_yet_effective', 'gated', 'ok' by the first source that is, 'degraded' if the row isn't fatal or
    a source is degraded, else 'fail' with all that was said, in the order of the sources."""
    v = verdicts.groupBy("row_id").agg(
        F.min_by("detail", F.when(F.col("ok"), F.col("place"))).alias("good"), F.bool_or("ok").alias("any_ok"), F.bool_or("degraded").alias("soft"), F.array_sort(F.collect_list(F.struct("place", "detail"))).alias("said")
    )
    x = rows.join(v, "row_id", "left")
    early = F.lit(today) < F.col("effective_date")
    status = F.when(early, "not_yet_effective").when(F.col("gated"), "gated").when(F.col("any_ok"), "ok").when(F.col("non_fatal") | F.coalesce("soft", F.lit(False)), "degraded").otherwise("fail")
    said = F.array_join(F.col("said.detail"), "; ")
    return x.withColumn("status", status).select("row_id", "cadence", "status", F.when(F.col("status") == "ok", F.col("good")).when(F.col("status").isin("degraded", "fail"), F.coalesce(said, F.lit(""))).otherwise("").alias("detail"))


def inventory_metrics(results: DataFrame) -> DataFrame:
    """(metric, value): 1 or 0 per row, and the number of rows by status."""
    each = results.select(F.concat(F.lit("row/"), "row_id").alias("metric"), (F.col("status") == "ok").cast("bigint").alias("value"))
    return each.unionByName(results.groupBy(F.concat(F.lit("status/"), "status").alias("metric")).agg(F.count(F.lit(1)).alias("value")))


def inventory_report(results: DataFrame) -> DataFrame:
    """One row: the totals by status and the percentage of gating rows that are ok (those that are neither pending, degraded nor gated)."""
    of = lambda s: F.count_if(F.col("status") == s)
    out = results.agg(F.count(F.lit(1)).alias("n"), of("ok").alias("ok"), of("fail").alias("fail"), of("degraded").alias("degraded"), of("gated").alias("gated"), of("not_yet_effective").alias("pending"))
    gating = F.col("n") - F.col("pending") - F.col("degraded") - F.col("gated")
    return out.withColumn("pct_ok", F.when(gating > 0, F.round(100.0 * F.col("ok") / gating, 2)))
