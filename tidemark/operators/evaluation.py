"""Evaluation statistics: rank correlations, calibration, clustered spreads, false discoveries, overfitting, regimes, benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import TRADING_DAYS, average_rank, finite, quantile_slots, ratio, value_ranks


SORTED_ROWS = 4_000_000  # rows of a group that one task may sort


def information_coefficient(rows: DataFrame, by: list[str], signal: str, outcome: str, least: int = 20, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Per group: Spearman's correlation over finite pairs with ties at their mean rank.

    Where no group has more than ``sorted_rows`` rows, a window sorts each; else ranks are counted over quantile slots of the groups, which gives
    the same for groups of any size.  Fewer than ``least`` pairs give null with status
    insufficient, no spread 0 with status no_variance."""
    x = rows.select(*by, finite(F.col(signal)).alias("s"), finite(F.col(outcome)).alias("o")).filter("s is not null and o is not null")
    if (x.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= sorted_rows:
        ranked = x.select(*by, "s", "o", average_rank(F.col("s"), by).alias("rs"), average_rank(F.col("o"), by).alias("ro"))
    else:
        ranked = x.join(value_ranks(x, by, "s", "rs"), [*by, "s"]).join(value_ranks(x, by, "o", "ro"), [*by, "o"])
    flat = (F.max("s") == F.min("s")) | (F.max("o") == F.min("o"))
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.covar_pop("rs", "ro"), F.stddev_pop("rs") * F.stddev_pop("ro")).alias("c"), flat.alias("flat"))
    status = F.when(F.col("n") < least, "insufficient").when(F.col("flat"), "no_variance").otherwise("ok")
    return out.select(*by, "n", F.when(F.col("n") >= least, F.when(F.col("flat"), 0.0).otherwise(F.col("c"))).alias("ic"), status.alias("status"))


def calibration(rows: DataFrame, probability: str, outcome: str, edges: list[float] | None = None, least: int = 0) -> DataFrame:
    """Per bin of predicted probability: n, mean prediction, observed rate, and the calibration error over all kept bins.

    Bins are [low, high), the last closed; the default ten have the edges k * 0.1 in binary floating point.  Bins of fewer than ``least``
    are marked and left out of the error."""
    cuts = edges or [i * 0.1 for i in range(10)] + [1.0]
    p = F.col("p")
    bin_of = F.lit(None).cast("int")
    for i in reversed(range(len(cuts) - 1)):
        inside = (p >= cuts[i]) & ((p <= cuts[i + 1]) if i == len(cuts) - 2 else (p < cuts[i + 1]))
        bin_of = F.when(inside, i).otherwise(bin_of)
    x = rows.select(finite(F.col(probability)).alias("p"), finite(F.col(outcome)).alias("y")).filter("p is not null and y is not null")
    bins = x.select(bin_of.alias("bin"), "p", (F.col("y") > 0).cast("double").alias("y")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    kept = F.col("n") >= least
    gap = F.when(kept, F.col("n") * F.abs(F.col("predicted") - F.col("observed")))
    whole = Window.partitionBy()
    return bins.select("bin", "n", "predicted", "observed", kept.alias("kept"), (F.sum(gap).over(whole) / F.sum(F.when(kept, F.col("n"))).over(whole)).alias("ece"))


def clustered_mean(rows: DataFrame, date: str, value: str, least: int = 1) -> DataFrame:
    """Per date: the mean over resolved rows, their number and that of the unresolved; dates of fewer than ``least`` resolved are left out."""
    x = rows.select(F.col(date).alias("date"), finite(F.col(value)).alias("v"))
    return x.groupBy("date").agg(F.avg("v").alias("mean"), F.count("v").alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("n_unresolved")).filter(F.col("n") >= least)


def seam_spread(inputs: DataFrame, outputs: DataFrame, date: str, value: str, least_names: int = 1, least_dates: int = 1) -> DataFrame:
    """One row: the mean over shared dates of output mean less input mean, each date of equal weight, with the dates of only one side
    counted; null with status insufficient_data below ``least_dates``."""
    a, b = clustered_mean(inputs, date, value, least_names), clustered_mean(outputs, date, value, least_names)
    j = a.select("date", F.col("mean").alias("i"), F.col("n").alias("ni")).join(b.select("date", F.col("mean").alias("o"), F.col("n").alias("no")), "date", "full_outer")
    both = F.col("i").isNotNull() & F.col("o").isNotNull()
    out = j.agg(F.count_if(both).alias("n_dates"), F.count_if(~both).alias("n_dropped"), F.avg(F.when(both, F.col("o") - F.col("i"))).alias("s"), F.sum("ni").alias("n_input"), F.sum("no").alias("n_output"))
    enough = F.col("n_dates") >= least_dates
    return out.select("n_dates", "n_dropped", "n_input", "n_output", F.when(enough, F.col("s")).alias("spread"), F.when(enough, "ok").otherwise("insufficient_data").alias("status"))


def unresolved_rates(inputs: DataFrame, outputs: DataFrame, value: str) -> DataFrame:
    """One row: the share of unresolved rows on either side of a seam, null for an empty side, and the output's less the input's."""
    side = lambda d, n: d.agg(ratio(F.count_if(finite(F.col(value)).isNull()).cast("double"), F.count(F.lit(1)).cast("double")).alias(n))
    return side(inputs, "input_rate").crossJoin(side(outputs, "output_rate")).withColumn("gap", F.col("output_rate") - F.col("input_rate"))


def seam_faults(inputs: DataFrame, outputs: DataFrame, date: str, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """(fault, date, key) of what forbids a comparison: 'duplicate_input' and 'duplicate_output' (a name twice on a date), 'not_in_input',
    'resolved_on_one_side' and 'outcomes_differ'; a table without rows is a sound seam.  Null outcomes are unresolved."""
    a, b = (d.select(F.col(date).alias("date"), F.col(key).alias("key"), finite(F.col(value)).alias("v")) for d in (inputs, outputs))
    twice = lambda d, n: d.groupBy("date", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(n).alias("fault"), "date", "key")
    one = lambda d, n: d.groupBy("date", "key").agg(F.max("v").alias(n)).withColumn(f"has_{n}", F.lit(True))
    j = one(b, "o").join(one(a, "i"), ["date", "key"], "left")
    fault = F.when(F.col("has_i").isNull(), "not_in_input").when(F.col("i").isNull() != F.col("o").isNull(), "resolved_on_one_side").when(F.abs(F.col("i") - F.col("o")) > tolerance, "outcomes_differ")
    return twice(a, "duplicate_input").unionByName(twice(b, "duplicate_output")).unionByName(j.select(fault.alias("fault"), "date", "key").filter("fault is not null"))


def assert_seam(inputs: DataFrame, outputs: DataFrame, date: str, key: str, value: str) -> None:
    found = seam_faults(inputs, outputs, date, key, value).limit(5).collect()
    if found:
        raise ValueError("the sides of the seam can't be compared: " + "; ".join(f"{r.fault} {r.date}/{r.key}" for r in found))


def seam_dates(inputs: DataFrame, outputs: DataFrame, date: str, value: str, least_names: int = 1) -> DataFrame:
    """The published rows of a seam: (date, input_mean, output_mean) of the dates that both sides have."""
    a, b = clustered_mean(inputs, date, value, least_names), clustered_mean(outputs, date, value, least_names)
    return a.select("date", F.col("mean").alias("input_mean")).join(b.select("date", F.col("mean").alias("output_mean")), "date")


def recompute_spread(published: DataFrame) -> DataFrame:
    """One row: the spread from the published rows (input_mean, output_mean) alone, null without any.  A row that lacks a mean fails."""
    bad = F.col("input_mean").isNull() | F.col("output_mean").isNull()
    gap = F.when(bad, F.raise_error(F.lit("a published row lacks a mean")).cast("double")).otherwise(F.col("output_mean") - F.col("input_mean"))
    return published.agg(F.avg(gap).alias("spread"))


def return_units(rows: DataFrame, by: list[str], column: str, percent: bool = False) -> DataFrame:
    """Per group whether ``column`` can be returns in the declared units: (by, n, low, high, median_abs, fault), judged in fractions.

    fault: 'lost_all' (a return of -100 % or worse, whose logarithm isn't defined), 'too_large' (beyond 500 %), 'median_too_large' (a median
    of more than 50 %), 'median_too_small' (under 5 basis points over ten values or more), else null.  What isn't finite doesn't count."""
    v = finite(F.col(column)) / (100.0 if percent else 1.0)
    out = rows.select(*by, v.alias("v")).filter("v is not null").groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile(F.abs("v"), F.lit(0.5)).alias("median_abs"))
    m = F.col("median_abs")
    fault = F.when(F.col("low") <= -1, "lost_all").when(F.greatest(F.abs("low"), F.abs("high")) > 5, "too_large").when(m > 0.5, "median_too_large").when((F.col("n") >= 10) & (m > 0) & (m < 5e-4), "median_too_small")
    return out.withColumn("fault", fault)


def canonical_log_alphas(rows: DataFrame, by: list[str], published: str, r: str, benchmark: str) -> DataFrame:
    """``rows`` with log_alpha: the published one in groups that have any (then null where it is missing), else from the returns in fractions."""
    w = Window.partitionBy(*by)
    has = F.max(F.col(published).isNotNull()).over(w)
    return rows.withColumn("__has", has).withColumn("log_alpha", F.when(F.col("__has"), F.col(published)).otherwise(log_alpha(F.col(r), F.col(benchmark)))).drop("__has")


def input_window(rows: DataFrame, date: str) -> DataFrame:
    """One row: first and last usable date and the number of rows."""
    return rows.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"), F.count(F.lit(1)).alias("n_rows"))


def input_freshness(window: DataFrame, as_of: Column, horizon_days: int, grace_days: int = 14) -> DataFrame:
    """``window`` with status 'ok' or 'unmeasurable': the newest input may be as old as the outcome takes (7 calendar days for 5 trading days)
    and the grace allow; also unmeasurable without rows or dates."""
    allowed = math.ceil(horizon_days * 7 / 5) + grace_days
    ok = (F.col("n_rows") > 0) & F.col("max_date").isNotNull() & (F.col("max_date") >= F.date_sub(as_of, allowed))
    return window.withColumn("age_days", F.datediff(as_of, F.col("max_date"))).withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("unmeasurable"))


def regime_report(strata: DataFrame, spreads: dict[int, DataFrame], window: DataFrame, run: dict[str, str]) -> DataFrame:
    """One row, payload: the evaluation as one JSON document of the run's fields, the input window, a spread per horizon and the strata in order."""
    fields = [F.col(c) for c in strata.columns]
    body = strata.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("strata")).crossJoin(window.select(F.struct(*window.columns).alias("input_window")))
    for h, s in spreads.items():
        body = body.crossJoin(s.select(F.struct(*s.columns).alias(f"spread_{h}d")))
    return body.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in run.items()], F.array(*map(F.lit, spreads)).alias("horizons"), "input_window", *[f"spread_{h}d" for h in spreads], "strata")).alias("payload"))


def false_discoveries(tests: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over all tests: (key, p, rank, significant).

    The ranks need one order of all p-values.  They are counted without a single-task sort: p-values fall into slots between their approximate
    quantiles, whose counts give what comes before a slot, and the rank inside a slot is a window of its own."""
    x = quantile_slots(tests.select(F.col(key).alias("key"), finite(F.col(p)).alias("p")).filter("p is not null"), [], "p", 4096).withColumnRenamed("__slot", "slot")
    counts = x.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("slot", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy("p", "key"))
    ranked = x.withColumn("inside", inside).join(F.broadcast(before), "slot").select("key", "p", (F.col("before") + F.col("inside")).alias("rank"), "total")
    last = ranked.filter(F.col("p") <= F.col("rank") / F.col("total") * alpha).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last"))
    return ranked.crossJoin(F.broadcast(last)).select(F.col("key").alias(key), "p", "rank", (F.col("rank") <= F.col("last")).alias("significant"))


def overfitting(ic: DataFrame, split: str, spec: str, value: str, least: int = 4) -> DataFrame:
    """One row: the share of splits whose in-sample best spec (by the mean of the other splits, first spec on ties) ranks in the lower half
    out of sample.  Splits with a missing value are left out."""
    x = ic.select(F.col(split).alias("split"), F.col(spec).alias("spec"), finite(F.col(value)).alias("v"))
    n_specs = x.select("spec").distinct().count()
    clean = x.groupBy("split").agg(F.count("v").alias("n")).filter(F.col("n") == n_specs).select("split")
    x = x.join(clean, "split")
    by_spec, by_split = Window.partitionBy("spec"), Window.partitionBy("split")
    x = x.withColumn("others", (F.sum("v").over(by_spec) - F.col("v")) / (F.count("v").over(by_spec) - 1))
    x = x.withColumn("best", F.row_number().over(by_split.orderBy(F.desc(F.round("others", 12)), "spec"))).withColumn("w", average_rank(F.col("v"), ["split"]) / (n_specs + 1.0))
    best = x.filter("best = 1").withColumn("logit", F.log(F.col("w") / (1 - F.col("w"))))
    out = best.agg(F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("p"), F.percentile("logit", 0.5).alias("median_logit"))
    enough = (F.col("n_splits") >= least) & F.lit(n_specs >= 2)
    return out.select("n_splits", F.lit(n_specs).alias("n_specs"), F.when(enough, F.round("p", 6)).alias("pbo"), F.when(enough, F.round("median_logit", 6)).alias("median_logit"))


def regime_sortino(rows: DataFrame, regime: str, horizon: str, log_alpha: str, beat: str, least: int = 5) -> DataFrame:
    """Per regime and horizon: n, hit rate, annualised Sortino and Sharpe of log alphas; null statistics below ``least``; null regimes out."""
    x = rows.select(F.col(regime).alias("regime"), F.col(horizon).alias("horizon"), finite(F.col(log_alpha)).alias("a"), F.col(beat).cast("double").alias("b")).filter("regime is not null and horizon is not null and a is not null")
    out = x.groupBy("regime", "horizon").agg(F.count("a").alias("n"), F.avg("b").alias("hit"), F.avg("a").alias("m"), F.sqrt(F.avg(F.pow(F.least("a", F.lit(0.0)), 2))).alias("d"), F.stddev_samp("a").alias("sd"))
    f, enough = F.sqrt(TRADING_DAYS / F.col("horizon")), F.col("n") >= least
    return out.select(
        "regime",
        "horizon",
        "n",
        F.when(enough, F.col("hit")).alias("hit_rate"),
        F.when(enough & (F.col("n") >= 2) & (F.col("d") >= 1e-12), F.col("m") / F.col("d") * f).alias("sortino"),
        F.when(enough & (F.col("n") >= 2) & (F.col("sd") >= 1e-12), F.col("m") / F.col("sd") * f).alias("sharpe"),
        F.when(enough, F.col("d")).alias("downside"),
    )


def regime_spread(strata: DataFrame, horizon: int, up: str = "bull", down: str = "bear") -> DataFrame:
    """One row: the Sortino of one regime less that of the other."""
    pick = lambda r: F.max(F.when(F.col("regime") == r, F.col("sortino")))
    out = strata.filter(F.col("horizon") == horizon).agg(pick(up).alias("up"), pick(down).alias("down")).withColumn("spread", F.col("up") - F.col("down"))
    verdict = F.when(F.col("spread").isNull(), "insufficient_sample").when(F.col("spread") > 0.3, "useful").when(F.col("spread") > -0.3, "neutral").otherwise("inverted")
    return out.withColumn("verdict", verdict)


def log_alpha(r: Column, benchmark: Column) -> Column:
    """log(1 + r) - log(1 + benchmark); fails on a loss of all or more, which no return in fractions can be."""
    guard = lambda c: F.when(c <= -1, F.raise_error(F.lit("a return at or below -100 %: not in fractions"))).otherwise(F.log1p(c))
    return guard(r) - guard(benchmark)


def week_of(date: Column) -> Column:
    """The first day of the rebalancing week, which starts on Tuesday."""
    return F.date_add(F.trunc(F.date_sub(date, 1), "week"), 1)


def rebalances(days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``days``(by..., date) with segment, the number of rebalancing days up to and including it, and is_rebalance, set on the first row of each week."""
    keys = by or []
    w = Window.partitionBy(*keys).orderBy("date")
    first = F.lag(week_of(F.col("date"))).over(w)
    marked = days.withColumn("is_rebalance", first.isNull() | (first != week_of(F.col("date"))))
    return marked.withColumn("segment", F.sum(F.col("is_rebalance").cast("int")).over(w))


def high_volatility_benchmark(prices_with_ret: DataFrame, calendar_days: DataFrame, quantile: float = 0.75, lookback: int = 60, least: int = 60) -> DataFrame:
    """Per day: the equal-weight return of the names whose volatility over the ``lookback`` days before the last rebalancing was in the top
    quantile.  A segment is open at both ends: its returns start the day after a rebalancing and stop the day before the next.

    ``calendar_days``(date) drives the rebalancing; the volatilities are windows per symbol, the quantile an aggregate per rebalancing day."""
    days = rebalances(calendar_days.select("date").distinct())
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-lookback, -1)
    x = prices_with_ret.select("symbol", "date", "ret").join(F.broadcast(days), "date")
    x = x.withColumn("vol", F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w)))
    at = x.filter("is_rebalance and vol is not null").select("symbol", "segment", "vol")
    cut = at.groupBy("segment").agg(F.percentile("vol", quantile).alias("cut"))
    chosen = at.join(F.broadcast(cut), "segment").filter("vol >= cut").select("symbol", "segment")
    held = x.filter("!is_rebalance and ret is not null").select("symbol", "date", "segment", "ret").join(chosen, ["symbol", "segment"])
    return held.groupBy("date").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n_names"))


def beta_matched(series: DataFrame, portfolio: str, market: str, lookback: int = 60) -> DataFrame:
    """Per day: the market's return times the portfolio's beta over the ``lookback`` days before the last rebalancing; open segments.

    One row per day in, so its single ordered window is bounded by the calendar."""
    days = rebalances(series.select("date", F.col(portfolio).alias("p"), F.col(market).alias("m")))
    o = Window.partitionBy().orderBy("date")
    w = o.rowsBetween(-lookback, -1)
    beta = F.when(F.count("p").over(w) >= lookback, ratio(F.covar_samp("p", "m").over(w), F.var_samp("m").over(w)))
    at = days.withColumn("b", F.when(F.col("is_rebalance"), beta))
    held = at.withColumn("beta", F.last("b", ignorenulls=True).over(o))
    return held.filter("!is_rebalance and beta is not null").select("date", "beta", (F.col("beta") * F.col("m")).alias("ret"))


def alpha_against(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row over the shared dates: total returns, alpha, information ratio (0 without spread)."""
    j = portfolio.select("date", F.col("ret").alias("p")).join(benchmark.select("date", F.col("ret").alias("b")), "date").filter("p is not null and b is not null")
    out = j.agg(F.count(F.lit(1)).alias("n_days"), (F.exp(F.sum(F.log1p("p"))) - 1).alias("total"), (F.exp(F.sum(F.log1p("b"))) - 1).alias("bench"), F.avg(F.col("p") - F.col("b")).alias("m"), F.stddev_samp(F.col("p") - F.col("b")).alias("sd"))
    return out.select("n_days", F.col("total").alias("portfolio_return"), F.col("bench").alias("benchmark_return"), (F.col("total") - F.col("bench")).alias("alpha"), F.when(F.col("sd") > 1e-12, F.col("m") / F.col("sd") * math.sqrt(TRADING_DAYS)).otherwise(0.0).alias("information_ratio"))
