"""Return statistics as grouped aggregates: volatility, ratios, drawdown, value at risk, expectancy, significance.

Inputs are long, (group..., r) or (group..., t, v).  What isn't finite is dropped before any statistic; what is undefined is null.
All but drawdown and autocovariances are plain aggregates, combined on the map side, so a hot group costs no more than others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import TRADING_DAYS, finite, normal_cdf, normal_density, normal_quantile, ratio


def _clean(rows: DataFrame, by: list[str], r: str) -> DataFrame:
    return rows.select(*by, finite(F.col(r)).alias("r")).filter("r is not null")


def risk_stats(rows: DataFrame, by: list[str], r: str, risk_free: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """Per group: n, mean, volatility, sharpe, downside, sortino.  Fewer than two returns, no spread or no downside give null."""
    root, rf = math.sqrt(periods), risk_free / periods
    x = F.col("r")
    n, mean, sd = F.count("r"), F.avg("r"), F.stddev_samp("r")
    down = F.sqrt(F.avg(F.pow(F.least(x - rf, F.lit(0.0)), 2)))
    out = _clean(rows, by, r).groupBy(*by).agg(n.alias("n"), mean.alias("mean"), sd.alias("sd"), down.alias("down"), (F.max("r") > F.min("r")).alias("spread"))
    two = F.col("n") >= 2
    return out.select(
        *by,
        "n",
        "mean",
        F.when(two, F.col("sd") * root).alias("volatility"),
        F.when(two & F.col("spread"), (F.col("mean") - rf) / F.col("sd") * root).alias("sharpe"),
        F.when(two, F.col("down")).alias("downside"),
        F.when(two, ratio(F.col("mean") - rf, F.col("down")) * root).alias("sortino"),
    )


def value_at_risk(rows: DataFrame, by: list[str], r: str, confidence: float = 0.95, horizon: int = 1) -> DataFrame:
    """Per group: parametric and historical VaR and CVaR, as losses floored at 0.

    The historical tail is a second aggregate over the losses at or above the group's quantile, which is exact.
    """
    z = normal_quantile(confidence)
    clean = _clean(rows, by, r)
    one = clean.groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.percentile(-F.col("r"), confidence).alias("q"), F.max(-F.col("r")).alias("worst"))
    one = one.withColumn("var_hist", F.greatest("q", F.lit(0.0)))
    tail = clean.join(one.select(*by, "var_hist"), by).filter(-F.col("r") >= F.col("var_hist")).groupBy(*by).agg(F.avg(-F.col("r")).alias("tail"))
    spread = F.col("sd") * math.sqrt(horizon)
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return one.join(tail, by, "left").select(
        *by,
        "n",
        F.when(F.col("n") >= 2, floor(z * spread - F.col("m") * horizon)).alias("var_param"),
        F.when(F.col("n") >= 2, floor(spread * (normal_density(z) / (1 - confidence)) - F.col("m") * horizon)).alias("cvar_param"),
        "var_hist",
        floor(F.coalesce("tail", "worst")).alias("cvar_hist"),
    )


def max_drawdown(rows: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Per group: the deepest fall from a running peak, at most 0; null below two values or for a peak at or below zero."""
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.select(*by, t, finite(F.col(v)).alias("v")).filter("v is not null")
    peak = x.withColumn("peak", F.max("v").over(w))
    out = peak.groupBy(*by).agg(F.count("v").alias("n"), F.min("peak").alias("lowest_peak"), F.min(F.when(F.col("peak") > 0, F.col("v") / F.col("peak") - 1)).alias("d"))
    return out.select(*by, F.when((F.col("n") >= 2) & (F.col("lowest_peak") > 0), F.col("d")).alias("max_drawdown"))


def time_weighted_return(points: DataFrame, by: list[str], t: str, value: str, flow: str) -> DataFrame:
    """Per group: the product over successive valuations of end / (begin + flow at begin), less 1; null where nothing was invested."""
    w = Window.partitionBy(*by).orderBy(t)
    base = F.lag(F.col(value) + F.col(flow)).over(w)
    step = points.select(*by, F.col(value).alias("end"), base.alias("base")).filter("base is not null")
    out = step.groupBy(*by).agg(F.min("base").alias("low"), F.product(ratio(F.col("end"), F.col("base"))).alias("p"))
    return out.select(*by, F.when(F.col("low") > 0, F.col("p") - 1).alias("twr"))


def annualized(total: Column, days: Column) -> Column:
    return F.when((days > 0) & (total > -1), F.pow(1 + total, 365.0 / days) - 1)


def cumulative(begin: Column, end: Column, contributions: Column) -> Column:
    return F.when(begin > 0, (end - contributions) / begin - 1)


def internal_rate(flows: DataFrame, by: str, t: str, amount: str) -> DataFrame:
    """Per group: the money-weighted yearly rate (act/365).  Equal days are summed first; the rate is found in one Arrow group per
    account, whose rows are then bounded by its days.  Null without both signs or without a root in [-0.9999, 100]."""
    import numpy as np
    import pandas as pd

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        a = rows["a"].to_numpy(float)
        y = (pd.to_datetime(rows["t"]) - pd.to_datetime(rows["t"].iloc[0])).dt.days.to_numpy() / 365.0
        npv = lambda r: float((a / (1 + r) ** y).sum())
        rate = None
        if (a > 0).any() and (a < 0).any():
            lo, hi = -0.9999, 100.0
            grid = np.concatenate([np.linspace(lo, 1, 200), np.geomspace(1.01, hi, 60)])
            vals = np.array([npv(g) for g in grid])
            cross = np.flatnonzero(np.sign(vals[:-1]) * np.sign(vals[1:]) <= 0)
            if len(cross):
                k = cross[np.argmin(np.abs(grid[cross] - 0.1))]
                lo, hi = grid[k], grid[k + 1]
                for _ in range(200):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if np.sign(npv(mid)) == np.sign(npv(lo)) else (lo, mid)
                rate = (lo + hi) / 2
        return pd.DataFrame({by: [rows["k"].iloc[0]], "irr": [rate]})

    daily = flows.groupBy(F.col(by).alias("k"), F.to_date(t).alias("t")).agg(F.sum(amount).alias("a")).filter("k is not null and t is not null")
    kind = flows.schema[by].dataType.simpleString()
    return daily.groupBy("k").applyInPandas(solve, f"{by} {kind}, irr double")


def expectancy(rows: DataFrame, by: list[str], r: str, threshold: float = 0.0, least: int = 10) -> DataFrame:
    """Per group (null groups left out): hit rate, mean win and loss, their ratio, and the expected excess over ``threshold``."""
    x = _clean(rows.filter(" and ".join(f"{b} is not null" for b in by)), by, r).withColumn("e", F.col("r") - threshold)
    win = F.when(F.col("e") > 0, F.col("e"))
    out = x.groupBy(*by).agg(F.count("e").alias("n"), F.count(win).alias("wins"), F.avg(win).alias("w"), F.avg(F.when(F.col("e") <= 0, -F.col("e"))).alias("l"))
    hit = F.col("wins") / F.col("n")
    enough = F.col("n") >= least
    status = F.when(~enough, "insufficient").when(F.col("wins") == 0, "no_wins").when(F.col("wins") == F.col("n"), "no_losses").otherwise("ok")
    value = hit * F.coalesce("w", F.lit(0.0)) - (1 - hit) * F.coalesce("l", F.lit(0.0))
    return out.select(*by, "n", status.alias("status"), F.when(enough, hit).alias("hit_rate"), F.when(enough, F.col("w")).alias("avg_win"), F.when(enough, F.col("l")).alias("avg_loss"), F.when(enough, ratio(F.col("w"), F.col("l"))).alias("win_loss"), F.when(enough, value).alias("expectancy"))


def sharpe_significance(rows: DataFrame, by: list[str], r: str, benchmark: float = 0.0, least: int = 30) -> DataFrame:
    """Per group: Sharpe per period and the probability that it exceeds ``benchmark``, given skewness and kurtosis (population moments)."""
    out = sharpe_moments(_clean(rows, by, r), by)
    z = (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt("room")
    p = F.when(F.col("room") <= 0, 0.5).otherwise(normal_cdf(z))
    return out.select(*by, "n", "sharpe", F.when(F.col("n") >= least, p).alias("psr"))


def sharpe_moments(clean: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, sharpe, room): room is n - 1 times the squared standard error of the Sharpe ratio, by skewness and kurtosis."""
    out = clean.groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("g3"), F.kurtosis("r").alias("g4"), (F.max("r") > F.min("r")).alias("spread"))
    sr = F.when(F.col("spread"), F.col("m") / F.col("sd")).otherwise(0.0)
    g3, g4 = F.when(F.col("spread"), F.col("g3")).otherwise(0.0), F.when(F.col("spread"), F.col("g4")).otherwise(0.0)
    return out.select(*by, "n", sr.alias("sharpe"), (1 - g3 * sr + (g4 + 2) / 4 * sr * sr).alias("room"))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """The Sharpe ratio the best of ``trials`` skill-less strategies is expected to show."""
    if trials < 1:
        raise ValueError("trials must be at least 1")
    if trials == 1:
        return 0.0
    a = math.sqrt(2 * math.log(trials))
    return math.sqrt(variance) * (a - (0.5772156649015329 + math.log(math.log(trials))) / (2 * a))


def deflated_sharpe(rows: DataFrame, by: list[str], r: str, trials: int, least: int = 30) -> DataFrame:
    """Per group: Sharpe per period, the one that the best of ``trials`` without skill is expected to show (over the standard error of this
    Sharpe), and the probability of exceeding it; null below ``least`` returns.  One trial is the plain probability against 0."""
    if trials < 1:
        raise ValueError("trials must be at least 1")
    out = sharpe_moments(_clean(rows, by, r), by)
    se = F.sqrt(F.greatest(F.col("room"), F.lit(0.0)) / (F.col("n") - 1))
    bar = se * expected_max_sharpe(1.0, trials)
    p = F.when(F.col("room") <= 0, 0.5).otherwise(normal_cdf((F.col("sharpe") - bar) / F.when(se > 0, se)))
    enough = F.col("n") >= least
    return out.select(*by, "n", "sharpe", F.when(enough, bar).alias("threshold"), F.when(enough, p).alias("dsr"), F.when(enough, "ok").otherwise("insufficient").alias("status"))


def wilson(successes: Column, trials: Column, level: float = 0.95) -> Column:
    """Struct(low, high): Wilson's score interval, null without trials."""
    z = normal_quantile(0.5 + level / 2)
    s = F.greatest(F.lit(0), F.least(successes, trials))
    p, z2 = s / trials, z * z
    mid = (p + z2 / (2 * trials)) / (1 + z2 / trials)
    half = z / (1 + z2 / trials) * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))
    return F.when(trials > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def newey_west(rows: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Per group: mean and its standard error with Bartlett weights over floor(4 (n/100)^(2/9)) lags, at most n - 1.

    As many lags are laid out as the largest group asks for (n grows 23-fold for twice the lags: 20 at 1.2e5 rows, 158 at 1e9)."""
    w = Window.partitionBy(*by)
    x = rows.select(*by, t, finite(F.col(v)).alias("v")).filter("v is not null")
    lags = F.least(F.floor(4 * F.pow(F.col("n") / 100.0, 2.0 / 9.0)), F.col("n") - 1)
    stats = x.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("m")).withColumn("lags", lags)
    most = stats.agg(F.max("lags")).first()[0] or 0
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], F.lit(True))
    e = x.alias("x").join(stats.alias("s"), same).select(*[F.col(f"x.{c}").alias(c) for c in by], F.col(f"x.{t}").alias(t), "n", "m", "lags", (F.col("v") - F.col("m")).alias("e"))
    o = w.orderBy(t)
    total = F.col("e") * F.col("e")
    for j in range(1, most + 1):
        weight = 1 - j / (F.col("lags") + 1.0)
        total = total + F.when(F.lit(j) <= F.col("lags"), 2 * weight * F.col("e") * F.coalesce(F.lag("e", j).over(o), F.lit(0.0))).otherwise(0.0)
    long = e.select(*by, "n", "m", total.alias("s"))
    out = long.groupBy(*by).agg(F.max("n").alias("n"), F.max("m").alias("mean"), F.sum("s").alias("s"))
    return out.select(*by, "n", "mean", F.when(F.col("n") >= 2, F.sqrt(F.greatest("s", F.lit(0.0))) / F.col("n")).alias("std_error"))


def _poisson_sums(by: list[str], resamples: int):
    """Per task and group: for every resample the number of draws, and the sums of the drawn values and of their squares."""
    import numpy as np
    import pandas as pd

    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    steps = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def draws(h: np.ndarray) -> np.ndarray:
        x = h.astype(np.int64).view(np.uint64)[:, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
        return np.searchsorted(edges, u).astype(np.float64)

    def run(batches):
        held: dict = {}

        def flush():
            rows = [(*k, s.ravel().tolist()) for k, s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*by, "sums"])

        for b in batches:
            for k, rows in b.groupby(by, dropna=False, sort=False):
                sums = held.setdefault(k, np.zeros((resamples, 3)))
                for at in range(0, len(rows), 2048):
                    part = rows.iloc[at : at + 2048]
                    v, m = part["v"].to_numpy(), draws(part["h"].to_numpy())
                    sums += np.stack([m.sum(axis=0), v @ m, (v * v) @ m], axis=1)
            if len(held) > 10_000:
                yield flush()
        if held:
            yield flush()

    return run


def mean_of(n: Column, s: Column, _: Column) -> Column:
    return ratio(s, n)


def deviation_of(n: Column, s: Column, s2: Column) -> Column:
    """The standard deviation, divisor n - 1."""
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (s2 - s * s / n) / (n - 1))))


def sharpe_of(n: Column, s: Column, s2: Column) -> Column:
    return ratio(s / n, deviation_of(n, s, s2))


def bootstrap(rows: DataFrame, by: list[str], v: str, key: str, statistic: Callable[[Column, Column, Column], Column] = mean_of, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Per group: (n, value, low, high), a ``statistic`` of number, sum and sum of squares and its percentile interval over Poisson resamples.

    Each row draws its multiplicities from a hash of its key, so the sums of all resamples are made in one pass over any number of rows,
    which aren't multiplied: tasks hand on three numbers per group and resample.  The result doesn't depend on how rows are partitioned."""
    x = rows.select(*by, F.xxhash64(F.col(key), F.lit(seed)).alias("h"), finite(F.col(v)).alias("v")).filter("v is not null")
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    parts = x.mapInPandas(_poisson_sums(by, resamples), f"{kinds}, sums array<double>")
    cell = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda i: F.struct(F.get("sums", i * 3).alias("n"), F.get("sums", i * 3 + 1).alias("s"), F.get("sums", i * 3 + 2).alias("q"))))
    sums = parts.select(*by, cell.alias("i", "c")).groupBy(*by, "i").agg(F.sum("c.n").alias("n"), F.sum("c.s").alias("s"), F.sum("c.q").alias("q"))
    each = sums.select(*by, statistic(F.col("n"), F.col("s"), F.col("q")).alias("m"))
    lo = (1 - level) / 2
    ci = each.groupBy(*by).agg(F.percentile("m", lo).alias("low"), F.percentile("m", 1 - lo).alias("high"))
    point = x.groupBy(*by).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    value = statistic(F.col("n").cast("double"), F.col("s"), F.col("q"))
    p, c = point.alias("p"), ci.alias("c")
    same = reduce(lambda a, b: a & b, [F.col(f"p.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by])
    enough = F.col("n") >= 2
    return p.join(c, same, "left").select(*[F.col(f"p.{b}").alias(b) for b in by], "n", value.alias("value"), F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def bootstrap_mean(rows: DataFrame, by: list[str], v: str, key: str, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Per group: the mean and its percentile interval over Poisson resamples; see ``bootstrap``."""
    return bootstrap(rows, by, v, key, mean_of, resamples, level, seed).withColumnRenamed("value", "mean")
