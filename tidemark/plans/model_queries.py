"""Queries of factor risk models, seam guards, units, horizons and deflated Sharpe ratios, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation, portfolio, risk
from tidemark.operators.horizons import Horizons
from tidemark.plans.portfolio_queries import _SIDES, _sides
from tidemark.plans.series_queries import RETURNS, _daily, _r, prices
from tidemark.session import table


def _model(spark, sf):
    d = _daily(spark, sf).filter("ret is not null").select("date", F.col("symbol").alias("ticker"), "ret")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), (F.col("s_acctbal") / 1000).alias("size"))
    first = prices(spark, sf).select(F.trunc("date", "month").alias("date")).distinct()
    loads = first.crossJoin(F.broadcast(s)).select("date", "ticker", (F.col("size") + F.month("date")).alias("size"))
    return portfolio.factor_risk_model(d, loads, ["size"], "sample", least_idio=30)


def factor_risk_f(spark, sf):
    return _r(_model(spark, sf)["F"], 7, "v")


def factor_risk_d(spark, sf):
    return _r(_model(spark, sf)["D"], 5, "v")


def factor_risk_metadata(spark, sf):
    return _model(spark, sf)["metadata"]


def _benchmark(spark, sf):
    d = _daily(spark, sf).filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret"))
    return d.withColumns({"season": F.sin(F.dayofyear("date") / 58.0), "trend": F.year("date") - 1995.0})


def benchmark_exposure(spark, sf):
    return _r(portfolio.benchmark_exposure(_benchmark(spark, sf), "ret", ["season", "trend"]), 6, "b")


def holdings_betas(spark, sf):
    d = _daily(spark, sf).filter("ret is not null").select("date", F.col("symbol").alias("ticker"), "ret")
    f = _benchmark(spark, sf).select("date", "season", "trend")
    return _r(portfolio.holdings_model(d, f, ["season", "trend"])["betas"], 5, "b")


def brinson_identity(spark, sf):
    return _r(portfolio.brinson_totals(portfolio.brinson(*_sides(spark, sf), "period", "grp"), "period"), 9, "active_return", "total_effect")


def turnover_cost(spark, sf):
    costs = portfolio.TransactionCosts.from_config({"half_spread": 3, "impact": 8.0, "note": "x"})
    p = table(spark, sf, "part")
    traded, adv = F.col("p_retailprice") * (F.col("p_size") - 25), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") * 60)
    return p.select("p_partkey", F.round(costs.round_trip_bps(traded, adv), 7).alias("round_trip_bps"), F.round(costs.cost_for_turnover(traded, adv), 6).alias("cost"))


def deflated_sharpe(spark, sf):
    return _r(risk.deflated_sharpe(_daily(spark, sf), ["symbol"], "ret", 40), 6, "sharpe", "threshold", "dsr").drop("dsr")


def deflated_sharpe_probability(spark, sf):
    return _r(risk.deflated_sharpe(_daily(spark, sf), ["symbol"], "ret", 40), 9, "sharpe", "threshold", "dsr")


def _seam(spark, sf):
    s = table(spark, sf, "alpha_signals").select(F.to_date("signal_ts").alias("d"), F.col("signal_id").alias("key"), "score", "horizon_days")
    return s, s.filter("horizon_days = 21 or key % 400 = 0").select("d", F.when(F.col("key") % 1000 == 7, -F.col("key")).otherwise(F.col("key")).alias("key"), F.when(F.col("key") % 300 == 0, F.col("score") + 1).when(F.col("key") % 501 != 0, F.col("score")).alias("score"))


def seam_faults(spark, sf):
    return evaluation.seam_faults(*_seam(spark, sf), "d", "key", "score")


def seam_rates(spark, sf):
    return _r(evaluation.unresolved_rates(*_seam(spark, sf), "score"), 9, "input_rate", "output_rate", "gap")


def seam_recomputed(spark, sf):
    return _r(evaluation.recompute_spread(evaluation.seam_dates(*_seam(spark, sf), "d", "score", 2)), 8, "spread")


def return_units(spark, sf):
    """Declared in fractions, whatever they are: one group per year and kind of fault that was put in."""
    d = _daily(spark, sf).filter("ret is not null").withColumn("kind", F.col("symbol") % 4)
    v = F.when(F.col("kind") == 0, F.col("ret") / 100).when(F.col("kind") == 1, F.col("ret") / 1e6).when(F.col("kind") == 2, F.col("ret") * 100).otherwise(F.least(F.col("ret"), F.lit(1.0)) / 10)
    out = evaluation.return_units(d.select("kind", F.year("date").alias("year"), v.alias("v")), ["kind", "year"], "v")
    return _r(out, 9, "low", "high", "median_abs")


def canonical_log_alphas(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 40 / 100.0).alias("r"), (F.col("o_orderkey") % 7 / 100.0).alias("b"), "o_orderpriority")
    o = o.withColumn("published", F.when((F.col("year") % 2 == 0) & (F.col("o_orderkey") % 3 == 0), 0.5))
    return _r(evaluation.canonical_log_alphas(o, ["year", "o_orderpriority"], "published", "r", "b").select("o_orderkey", "log_alpha"), 9, "log_alpha")


def input_freshness(spark, sf):
    s = table(spark, sf, "alpha_signals").filter("horizon_days is not null")
    w = evaluation.input_window(s.select(F.to_date("signal_ts").alias("d")), "d")
    checks = [evaluation.input_freshness(w, F.lit(d).cast("date"), h).withColumn("as_of", F.lit(d)) for d, h in (("2025-09-15", 21), ("2026-09-15", 5))]
    return checks[0].unionByName(checks[1])


def horizon_targets(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 1e6).alias("log_alpha_21d"), (F.col("o_totalprice") / 1e5).alias("return_5d"), F.lit(1).alias("return_21d"))
    return Horizons(21, (63, 5)).long(o, ["o_orderkey"])


_QUERIES = [factor_risk_f, factor_risk_d, factor_risk_metadata, benchmark_exposure, holdings_betas, brinson_identity, turnover_cost, deflated_sharpe, deflated_sharpe_probability, seam_faults, seam_rates, seam_recomputed, return_units, canonical_log_alphas, input_freshness, horizon_targets]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_FM = f"""{RETURNS}, ff as (select distinct date_trunc('month', date)::date ld from prices),
dd as (select date, max(ld) ld from (select distinct date from rets where ret is not null) join ff on ld < date group by 1),
x as (select r.date, symbol, ret y, s_acctbal / 1000 + month(ld) x from rets r join dd using (date) join supplier on s_suppkey = symbol where ret is not null),
fit as (select date, regr_intercept(y, x) market, regr_slope(y, x) size from x group by 1 having count(*) >= 6)"""
_SEAM = """i as (select signal_ts::date d, signal_id k, score v, horizon_days h from alpha_signals),
o as (select d, case when k % 1000 = 7 then -k else k end k, case when k % 300 = 0 then v + 1 when k % 501 <> 0 then v end v from i where h = 21 or k % 400 = 0),
ii as (select d, k, max(v) v, true has from i group by 1, 2), oo as (select d, k, max(v) v from o group by 1, 2)"""
_TWO = """g as (select {by} count(*) n, covar_pop(a, a) aa, covar_pop(a, b) ab, covar_pop(b, b) bb, covar_pop(a, y) ay, covar_pop(b, y) by_ from x {group})"""


def oracle_sql() -> dict[str, str]:
    moments = f"""{RETURNS}, d as (select symbol, ret from rets where ret is not null), m as (select symbol, count(*) n, avg(ret) m, stddev_samp(ret) sd, max(ret) > min(ret) sp, avg(ret) mu from d group by 1),
c as (select symbol, avg((ret - mu) ** 2) m2, avg((ret - mu) ** 3) m3, avg((ret - mu) ** 4) m4 from d join m using (symbol) group by 1),
s as (select symbol, n, case when sp then m / sd else 0 end sr, case when sp then m3 / m2 ** 1.5 else 0 end g3, case when sp then m4 / m2 ** 2 - 3 else 0 end g4 from m join c using (symbol)),
r as (select *, sqrt(greatest(1 - g3 * sr + (g4 + 2) / 4 * sr * sr, 0) / (n - 1)) se, sqrt(2 * ln(40)) a from s)"""
    season = "x as (select {who} y, sin(dayofyear(date) / 58.0) a, year(date) - 1995.0 b from {src})"
    solve = "(ay * bb - by_ * ab) / (aa * bb - ab * ab)", "(by_ * aa - ay * ab) / (aa * bb - ab * ab)"
    return {
        "factor_risk_f": f"with {_FM} " + " union all ".join(f"select '{i}' i, '{j}' j, case when count(*) >= 30 then round(covar_samp({i}, {j}), 7) end v from fit" for i in ("market", "size") for j in ("market", "size")),
        "factor_risk_d": f"with {_FM} select symbol ticker, count(*) n, case when count(*) >= 30 then round(var_pop(y - market - size * x), 5) end v from x join fit using (date) group by 1",
        "factor_risk_metadata": f"with {_FM} select (select count(distinct date) from rets where ret is not null) n_dates, (select count(*) from fit) n_clean_dates, 2 k_eff, (select count(distinct symbol) from rets where ret is not null) n_tickers, 'sample' shrinkage",
        "benchmark_exposure": f"with {RETURNS}, q as (select date, avg(ret) ret from rets where ret is not null group by 1), {season.format(who='ret', src='q')}, {_TWO.format(by='', group='')} select 'season' factor, round({solve[0]}, 6) b from g union all select 'trend', round({solve[1]}, 6) from g",
        "holdings_betas": f"with {RETURNS}, q as (select * from rets where ret is not null), {season.format(who='symbol, ret', src='q')}, {_TWO.format(by='symbol,', group='group by symbol having count(*) >= 4')} select symbol ticker, 'season' factor, round({solve[0]}, 5) b from g union all select symbol, 'trend', round({solve[1]}, 5) from g",
        "brinson_identity": f"with {_SIDES}, t as (select period, sum(contribution) - sum(benchmark_contribution) a, sum(allocation + selection + interaction) t from e group by 1) select period, round(a, 9) active_return, round(t, 9) total_effect, abs(a - t) < 1e-9 identical from t",
        "turnover_cost": """with x as (select p_partkey, p_retailprice * (p_size - 25) nt, case when p_size % 7 <> 0 then p_retailprice * 60 end adv from part),
y as (select *, greatest(3.5 + case when adv > 0 then 8 * sqrt(abs(nt) / adv) else 0 end, 0) bps from x) select p_partkey, round(2 * bps, 7) round_trip_bps, round(abs(nt) * bps / 1e4, 6) cost from y""",
        "deflated_sharpe": f"with {moments} select symbol, n, round(sr, 6) sharpe, case when n >= 30 then round(se * (a - (0.5772156649015329 + ln(ln(40))) / (2 * a)), 6) end threshold, case when n >= 30 then 'ok' else 'insufficient' end status from r",
        "seam_faults": f"with {_SEAM} select 'duplicate_input' fault, d date, k key from i group by 2, 3 having count(*) > 1 union all select 'duplicate_output', d, k from o group by 2, 3 having count(*) > 1 union all select * from (select case when has is null then 'not_in_input' when (ii.v is null) <> (oo.v is null) then 'resolved_on_one_side' when abs(ii.v - oo.v) > 1e-9 then 'outcomes_differ' end f, oo.d, oo.k from oo left join ii on ii.d is not distinct from oo.d and ii.k = oo.k) where f is not null",
        "seam_rates": f"with {_SEAM}, r as (select (select count(*) filter (where v is null) / count(*) from i) a, (select count(*) filter (where v is null) / count(*) from o) b) select round(a, 9) input_rate, round(b, 9) output_rate, round(b - a, 9) gap from r",
        "seam_recomputed": f"with {_SEAM}, a as (select d, avg(v) m from i group by 1 having count(v) >= 2), b as (select d, avg(v) m from o group by 1 having count(v) >= 2) select round(avg(b.m - a.m), 8) spread from a join b using (d)",
        "return_units": f"""with {RETURNS}, d as (select symbol % 4 kind, year(date) as year, ret from rets where ret is not null),
v as (select kind, year, case kind when 0 then ret / 100 when 1 then ret / 1e6 when 2 then ret * 100 else least(ret, 1.0) / 10 end v from d),
g as (select kind, year, count(v) n, min(v) low, max(v) high, median(abs(v)) median_abs from v group by 1, 2)
select kind, year, n, round(low, 9) low, round(high, 9) high, round(median_abs, 9) median_abs,
case when low <= -1 then 'lost_all' when greatest(abs(low), abs(high)) > 5 then 'too_large' when median_abs > 0.5 then 'median_too_large' when n >= 10 and median_abs > 0 and median_abs < 5e-4 then 'median_too_small' end fault from g""",
        "canonical_log_alphas": """with o as (select o_orderkey, year(o_orderdate) y, o_orderpriority p, o_custkey % 40 / 100.0 r, o_orderkey % 7 / 100.0 b from orders), q as (select *, case when y % 2 = 0 and o_orderkey % 3 = 0 then 0.5 end pub from o)
select o_orderkey, round(case when bool_or(pub is not null) over (partition by y, p) then pub else ln(1 + r) - ln(1 + b) end, 9) log_alpha from q""",
        "input_freshness": """with w as (select min(signal_ts::date) min_date, max(signal_ts::date) max_date, count(*) n_rows from alpha_signals where horizon_days is not null), a(as_of, n) as (values (date '2025-09-15', 44), (date '2026-09-15', 21))
select w.*, (as_of - max_date)::int age_days, case when n_rows > 0 and max_date >= as_of - n::int then 'ok' else 'unmeasurable' end status, as_of::varchar as_of from w, a""",
        "horizon_targets": "select o_orderkey, 21 horizon, true is_primary, o_totalprice / 1e6 target from orders where o_orderkey % 2 = 0 union all select o_orderkey, 5, false, o_totalprice / 1e5 from orders",
    }
