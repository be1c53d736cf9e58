"""Attribution, linking, trading costs, cross-sectional scores and factor risk as joins and aggregates over long tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, rank_percent, ratio


def brinson(portfolio: DataFrame, benchmark: DataFrame, period: str, group: str) -> DataFrame:
    """Brinson-Fachler effects per period and group of (period, group, w, r) tables.

    A group of one side only has weight 0 on the other; its missing benchmark return is the benchmark's total, its missing portfolio return
    the benchmark's."""
    p = portfolio.select(F.col(period).alias("t"), F.col(group).alias("g"), F.col("w").alias("wp"), F.col("r").alias("rp"))
    b = benchmark.select(F.col(period).alias("t"), F.col(group).alias("g"), F.col("w").alias("wb"), F.col("r").alias("rb"))
    j = p.join(b, ["t", "g"], "full_outer").withColumns({"wp": F.coalesce("wp", F.lit(0.0)), "wb": F.coalesce("wb", F.lit(0.0))})
    total = F.coalesce(F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy("t")), F.lit(0.0))
    j = j.withColumn("tb", total).withColumn("rb", F.coalesce("rb", "tb")).withColumn("rp", F.coalesce("rp", "rb"))
    return j.select(
        F.col("t").alias(period),
        F.col("g").alias(group),
        ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("tb"))).alias("allocation"),
        (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
        (F.col("wp") * F.col("rp")).alias("contribution"),
        (F.col("wb") * F.col("rb")).alias("benchmark_contribution"),
    )


def carino(rp: Column, rb: Column) -> Column:
    """The logarithmic smoothing coefficient of a period; its limit where both returns are equal.  Fails on a loss of all or more."""
    close = F.abs(rp - rb) < 1e-12
    value = F.when(close, 1 / (1 + rb)).otherwise((F.log1p(rp) - F.log1p(rb)) / F.when(close, F.lit(1.0)).otherwise(rp - rb))
    return F.when((rp <= -1) | (rb <= -1), F.raise_error(F.lit("a period lost all")).cast("double")).otherwise(value)


def linked(effects: DataFrame, period: str, group: str) -> DataFrame:
    """Effects over all periods per group, so that they add up to the difference of the compounded returns."""
    e = effects.withColumnsRenamed({period: "t", group: "g"})
    totals = e.groupBy("t").agg(F.sum("contribution").alias("rp"), F.sum("benchmark_contribution").alias("rb"))
    whole = totals.agg((F.exp(F.sum(F.log1p("rp"))) - 1).alias("cp"), (F.exp(F.sum(F.log1p("rb"))) - 1).alias("cb"))
    scaled = totals.crossJoin(F.broadcast(whole)).select("t", (carino(F.col("rp"), F.col("rb")) / carino(F.col("cp"), F.col("cb"))).alias("k"))
    out = e.join(F.broadcast(scaled), "t").groupBy("g")
    return out.agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("allocation", "selection", "interaction")]).withColumnRenamed("g", group)


def cost_bps(notional: Column, adv: Column, sigma: Column | None = None, ref_sigma: Column | None = None, half_spread: float = 2.5, impact: float = 10.0, commission: float = 0.5, floor: float = 0.0) -> Column:
    """One side's cost in basis points: half spread, square-root impact scaled by relative volatility, commission; no impact without volume."""
    scale = F.lit(1.0) if sigma is None or ref_sigma is None else F.when((sigma > 0) & (ref_sigma > 0), sigma / ref_sigma).otherwise(1.0)
    push = F.when(adv > 0, impact * scale * F.sqrt(F.abs(notional) / adv)).otherwise(0.0)
    return F.greatest(F.lit(half_spread) + push + F.lit(commission), F.lit(floor))


def attractiveness(scores: DataFrame, by: list[str], name: str, pillar: str, value: str, weights: dict[str, float]) -> DataFrame:
    """Percentile of a weighted blend of z-scores per cross-section: (by, name, composite, score, n_pillars).

    A z-score is clipped to 3; a pillar without spread scores nobody; a name's blend is over the weights of the pillars it has.  Names without
    any have null scores and don't count in the percentile.  Negative weights are 0; all zero means equal."""
    pos = {k: max(0.0, v) for k, v in weights.items()}
    total = sum(pos.values())
    w = {k: v / total for k, v in pos.items()} if total else {k: 1 / len(pos) for k in pos}
    pairs = [F.lit(x) for kv in w.items() for x in kv]
    x = scores.select(*by, F.col(name).alias("name"), F.col(pillar).alias("pillar"), finite(F.col(value)).alias("v")).filter(F.col("pillar").isin(list(w)))
    cell = Window.partitionBy(*by, "pillar")
    spread = F.max("v").over(cell) > F.min("v").over(cell)
    z = F.when(spread, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("v") - F.avg("v").over(cell)) / F.stddev_pop("v").over(cell))))
    x = x.withColumn("z", z).withColumn("w", F.create_map(*pairs)[F.col("pillar")])
    out = x.groupBy(*by, "name").agg(ratio(F.sum(F.col("w") * F.col("z")), F.sum(F.when(F.col("z").isNotNull(), F.col("w")))).alias("composite"), F.count("z").alias("n_pillars"))
    return out.select(*by, F.col("name").alias(name), "composite", rank_percent(F.round("composite", 10), by).alias("score"), "n_pillars")


def tradeability(costs: DataFrame, by: list[str], cost: str) -> DataFrame:
    """``costs`` with the percentile of cheapness; null costs stay null."""
    return costs.withColumn("tradeability", rank_percent(-F.col(cost), by))


def least_squares(rows: DataFrame, key: str, y: str, x: list[str], least: int | None = None) -> DataFrame:
    """Per group: OLS with intercept, (key, n, intercept, betas array, resid_var), by its normal equations.

    The sums of products are one grouped aggregate over any number of rows; only the small matrices, one per group, go to Python, where the
    minimum-norm solution is taken, so rank-deficient factors are no error.  Groups of fewer than ``least`` rows are left out."""
    import numpy as np
    import pandas as pd

    k = len(x)
    clean = rows.select(F.col(key).alias("key"), finite(F.col(y)).alias("y"), *[finite(F.col(c)).alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(k)], F.col("y")]
    cells = [F.sum(cols[i] * cols[j]) for i in range(k + 2) for j in range(i, k + 2)]
    sums = clean.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("s")).filter(F.col("n") >= (k + 2 if least is None else least))

    def solve(batches):
        for b in batches:
            rows = []
            for kk, n, s in zip(b["key"], b["n"], b["s"], strict=True):
                g = np.zeros((k + 2, k + 2))
                g[np.triu_indices(k + 2)] = s
                g = g + np.triu(g, 1).T
                xtx, xty, yty = g[:-1, :-1], g[:-1, -1], g[-1, -1]
                beta = np.linalg.pinv(xtx, hermitian=True) @ xty
                rss = max(0.0, yty - beta @ xty)
                rows.append((kk, n, beta[0], beta[1:].tolist(), rss / max(n - k - 1, 1)))
            yield pd.DataFrame(rows, columns=["key", "n", "intercept", "betas", "resid_var"])

    kind = rows.schema[key].dataType.simpleString()
    return sums.mapInPandas(solve, f"key {kind}, n bigint, intercept double, betas array<double>, resid_var double").withColumnRenamed("key", key)


def covariance(rows: DataFrame, columns: list[str], shrinkage: str = "sample", least: int = 2) -> DataFrame:
    """(i, j, v): covariance of the columns over complete rows.  'sample' divides by n - 1; 'ledoit_wolf' shrinks the divisor-n covariance to a
    multiple of the identity, its intensity from fourth moments that are plain sums too.  Null below ``least`` rows."""
    c = [finite(F.col(x)).alias(x) for x in columns]
    clean = rows.select(*c).dropna()
    k = len(columns)
    mean = clean.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m_{x}") for x in columns])
    centred = clean.crossJoin(F.broadcast(mean)).select("n", *[(F.col(x) - F.col(f"m_{x}")).alias(x) for x in columns])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    square = sum((F.col(x) * F.col(x) for x in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    agg = centred.agg(F.max("n").alias("n"), F.sum(square * square).alias("q"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs])
    n = F.col("n")
    at = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    if shrinkage == "sample":
        cell = lambda i, j: at(i, j) / (n - 1)
    elif shrinkage == "ledoit_wolf":
        mu = sum((at(i, i) for i in range(1, k)), at(0, 0)) / n / k
        norm2 = sum((at(i, j) * at(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) / (n * n)
        d2 = norm2 - k * mu * mu
        b2 = F.least((F.col("q") / n - norm2) / n, d2)
        rho = F.when(d2 > 0, F.greatest(F.lit(0.0), b2 / d2)).otherwise(0.0)
        cell = lambda i, j: (1 - rho) * at(i, j) / n + (rho * mu if i == j else F.lit(0.0))
    else:
        raise ValueError(f"no such shrinkage: {shrinkage}")
    cells = F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.when(n >= least, cell(i, j)).alias("v")) for i in range(k) for j in range(k)])
    return agg.select(F.inline(cells))


def portfolio_risk(weights: DataFrame, betas: DataFrame, fcov: DataFrame, idio: DataFrame, periods: int = 252, benchmark: DataFrame | None = None) -> DataFrame:
    """One row: annualised factor, idiosyncratic and total volatility of (ticker, w) on (ticker, factor, b), (f1, f2, v), (ticker, v); with a
    ``benchmark`` of (factor, b), of the active exposures (tracking error).  Weights are scaled to the covered names."""
    covered = weights.join(idio.select("ticker", F.col("v").alias("d")), "ticker")
    w = covered.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))
    exposure = w.join(betas, "ticker").groupBy("factor").agg(F.sum(F.col("w") * F.col("b")).alias("x"))
    if benchmark is not None:
        exposure = exposure.join(benchmark.select("factor", F.col("b").alias("xb")), "factor", "full_outer").select("factor", (F.coalesce("x", F.lit(0.0)) - F.coalesce("xb", F.lit(0.0))).alias("x"))
    a, b = exposure.select(F.col("factor").alias("f1"), F.col("x").alias("x1")), exposure.select(F.col("factor").alias("f2"), F.col("x").alias("x2"))
    factor = fcov.join(F.broadcast(a), "f1").join(F.broadcast(b), "f2").agg(F.sum(F.col("x1") * F.col("v") * F.col("x2")).alias("fv"))
    own = w.agg(F.sum(F.col("w") * F.col("w") * F.col("d")).alias("iv"))
    vol = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)) * periods)
    return factor.crossJoin(own).select(vol(F.col("fv")).alias("factor_vol"), vol(F.col("iv")).alias("idio_vol"), vol(F.col("fv") + F.col("iv")).alias("total_vol"), ratio(F.col("fv"), F.col("fv") + F.col("iv")).alias("factor_share"))


def cross_sectional_factors(returns: DataFrame, loadings: DataFrame, factors: list[str], extra: int = 5) -> DataFrame:
    """Per date: factor returns f of r_t = a + B f, B the loadings of the last day strictly before t that has any: (date, n, intercept, betas,
    resid_var).  Dates of fewer than factors + ``extra`` names are left out.  The day of the loadings is looked up on the distinct dates."""
    return least_squares(_loaded(returns, loadings), "date", "ret", factors, least=len(factors) + extra)


def _loaded(returns: DataFrame, loadings: DataFrame) -> DataFrame:
    """``returns``(date, ticker, ret) with the loadings of the last day strictly before that has any."""
    dates = returns.select("date").distinct()
    known = loadings.select(F.col("date").alias("loaded")).distinct()
    both = dates.select(F.col("date").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("date").alias("loaded")).unionByName(known.select(F.col("loaded").alias("t"), F.lit(2).alias("side"), "loaded"))
    w = Window.partitionBy().orderBy("t", "side").rowsBetween(Window.unboundedPreceding, -1)
    asof = both.withColumn("last", F.last("loaded", ignorenulls=True).over(w)).filter("side = 1 and last is not null").select(F.col("t").alias("date"), F.col("last").alias("loaded"))
    r = returns.join(F.broadcast(asof), "date").select("date", "loaded", "ticker", "ret")
    l = loadings.withColumnRenamed("date", "loaded")  # noqa: E741
    return r.join(l, ["loaded", "ticker"])


def factor_residuals(returns: DataFrame, loadings: DataFrame, factors: list[str], fitted: DataFrame) -> DataFrame:
    """(date, ticker, residual) of ``fitted``, the factor returns by ``cross_sectional_factors``; nothing where a date wasn't fitted."""
    x = _loaded(returns, loadings).join(fitted.select("date", "intercept", "betas"), "date")
    explained = F.col("intercept")
    for i, f in enumerate(factors):
        explained = explained + F.col("betas")[i] * finite(F.col(f))
    return x.select("date", "ticker", (finite(F.col("ret")) - explained).alias("residual"))


def idiosyncratic_variance(residuals: DataFrame, least: int = 30) -> DataFrame:
    """(ticker, n, v): population variance of each ticker's residuals, null below ``least`` of them."""
    out = residuals.groupBy("ticker").agg(F.count("residual").alias("n"), F.var_pop("residual").alias("v"))
    return out.select("ticker", "n", F.when(F.col("n") >= least, F.col("v")).alias("v"))


def factor_risk_model(returns: DataFrame, loadings: DataFrame, factors: list[str], shrinkage: str = "ledoit_wolf", least_cov: int = 30, least_idio: int = 30) -> dict[str, DataFrame]:
    """The risk model end to end: 'factor_returns' per date, 'residuals', 'F' (i, j, v) over the intercept ('market') and the factors, null below
    ``least_cov`` dates, 'D' per ticker, and 'metadata' as one row."""
    fitted = cross_sectional_factors(returns, loadings, factors)
    names = ["market", *factors]
    series = fitted.select("date", F.col("intercept").alias("market"), *[F.col("betas")[i].alias(f) for i, f in enumerate(factors)])
    res = factor_residuals(returns, loadings, factors, fitted)
    n = returns.agg(F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("date").alias("n_dates")).crossJoin(series.agg(F.count(F.lit(1)).alias("n_clean_dates")))
    meta = n.select("n_dates", "n_clean_dates", F.lit(len(names)).alias("k_eff"), "n_tickers", F.lit(shrinkage).alias("shrinkage"))
    return {"factor_returns": series, "residuals": res, "F": covariance(series, names, shrinkage, least_cov), "D": idiosyncratic_variance(res, least_idio), "metadata": meta}


def holdings_model(holdings: DataFrame, factor_series: DataFrame, factors: list[str], shrinkage: str = "ledoit_wolf") -> dict[str, DataFrame]:
    """Time-series model of ``holdings``(date, ticker, ret) on ``factor_series``(date, factors...): 'betas' (ticker, factor, b), 'F' (f1, f2, v)
    and 'D' (ticker, v), as ``portfolio_risk`` takes them.  Tickers of fewer than factors + 2 common dates are left out."""
    fit = least_squares(holdings.join(factor_series, "date"), "ticker", "ret", factors)
    betas = fit.select("ticker", F.posexplode("betas").alias("i", "b")).select("ticker", F.array(*map(F.lit, factors))[F.col("i")].alias("factor"), "b")
    cov = covariance(factor_series, factors, shrinkage).select(F.col("i").alias("f1"), F.col("j").alias("f2"), "v")
    return {"betas": betas, "F": cov, "D": fit.select("ticker", F.col("resid_var").alias("v"))}


def benchmark_exposure(series: DataFrame, ret: str, factors: list[str]) -> DataFrame:
    """(factor, b): the betas of one series regressed on its factors."""
    fit = least_squares(series.withColumn("__all", F.lit(0)), "__all", ret, factors)
    return fit.select(F.posexplode("betas").alias("i", "b")).select(F.array(*map(F.lit, factors))[F.col("i")].alias("factor"), "b")


PILLARS = ("quality", "value", "momentum", "growth", "stewardship", "defensiveness")


def pillar_weights(raw: dict[str, float] | None) -> dict[str, float]:
    """Weights of the pillars, negatives as 0, scaled to sum to 1 (6 digits); equal where none is left."""
    kept = {k: max(0.0, float((raw or {}).get(k, 0.0))) for k in PILLARS}
    total = sum(kept.values())
    return {k: round(v / total, 6) if total else round(1 / len(PILLARS), 6) for k, v in kept.items()}


@dataclass(frozen=True)
class TransactionCosts:
    """Trading costs in basis points as column expressions; see ``cost_bps``."""

    half_spread: float = 2.5
    impact: float = 10.0
    commission: float = 0.5
    floor: float = 0.0

    @classmethod
    def from_config(cls, config: dict | None) -> TransactionCosts:
        """Of a mapping with any of the fields; unknown ones are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: float(v) for k, v in (config or {}).items() if k in known})

    def per_side_bps(self, notional: Column, adv: Column, sigma: Column | None = None, ref_sigma: Column | None = None) -> Column:
        return cost_bps(notional, adv, sigma, ref_sigma, self.half_spread, self.impact, self.commission, self.floor)

    def round_trip_bps(self, notional: Column, adv: Column, sigma: Column | None = None, ref_sigma: Column | None = None) -> Column:
        return 2 * self.per_side_bps(notional, adv, sigma, ref_sigma)

    def cost_for_turnover(self, turnover: Column, adv: Column, sigma: Column | None = None, ref_sigma: Column | None = None) -> Column:
        """In money: one side's cost of trading ``turnover``."""
        return F.abs(turnover) * self.per_side_bps(turnover, adv, sigma, ref_sigma) / 1e4


def brinson_totals(effects: DataFrame, period: str) -> DataFrame:
    """Per period: active_return, total_effect and whether they are the same (they are where both sides' weights sum to 1)."""
    out = effects.groupBy(period).agg((F.sum("contribution") - F.sum("benchmark_contribution")).alias("active_return"), F.sum(F.col("allocation") + F.col("selection") + F.col("interaction")).alias("total_effect"))
    return out.withColumn("identical", F.abs(F.col("active_return") - F.col("total_effect")) < 1e-9)
