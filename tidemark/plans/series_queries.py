"""Queries of series, gates, risk and evaluation operators, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import holidays, trading_days
from tidemark.operators import evaluation, risk, series
from tidemark.session import table

_YEARS = (1992, 2030)


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """A price series per supplier: revenue over quantity of the day."""
    li = table(spark, sf, "lineitem")
    day = li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
    return day.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


PRICES = """prices as (select l_suppkey symbol, l_shipdate::date date, sum(l_extendedprice) / sum(l_quantity) close, sum(l_quantity) volume
from lineitem group by 1, 2)"""
RETURNS = f"""{PRICES}, lagged as (select *, lag(close) over (partition by symbol order by date) before from prices),
rets as (select symbol, date, close, case when before <> 0 then close / before - 1 end ret from lagged)"""
CALENDAR = "closed as (select unnest([" + ", ".join(f"date '{d}'" for d in holidays(*_YEARS)) + f"""]) d),
days as (select x::date date from generate_series(date '{_YEARS[0]}-01-01', date '{_YEARS[1]}-12-31', interval 1 day) g(x)
where isodow(x) < 6 and x::date not in (select d from closed))"""


def _r(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def price_series_daily(spark, sf):
    return _r(prices(spark, sf), 6, "close")


def outlier_gate(spark, sf):
    return series.outliers(prices(spark, sf), n_sigma=2.0).select("symbol", "date", F.round("ret", 8).alias("ret"), F.round("vol", 8).alias("vol"))


def sanity_gate(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("symbol"), F.col("c_custkey").alias("date"), F.col("c_acctbal").alias("close"))
    out = series.sanity(c)
    return out.select("symbol", "n_bad", F.array_join(F.col("first_dates").cast("array<string>"), ",").alias("first_dates"), "passed")


def schema_gate(spark, sf):
    e = table(spark, sf, "run_executions").select(F.col("state_machine_arn").alias("symbol"), F.col("redrive_count").alias("volume"), F.col("output").alias("close"))
    return series.schema_gate(e, ["symbol", "volume", "close", "open"], ["volume", "close"])


def _orders_as_series(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("close"))


def staleness_gate(spark, sf):
    return series.staleness(_orders_as_series(spark, sf), trading_days(spark, *_YEARS), F.lit("1998-08-02").cast("date"), 120)


def continuity_gate(spark, sf):
    return series.continuity(prices(spark, sf), trading_days(spark, *_YEARS))


def monotonic_gate(spark, sf):
    return series.monotonic(_orders_as_series(spark, sf), "seq")


def quarantine_decision(spark, sf):
    o, cal = _orders_as_series(spark, sf), trading_days(spark, *_YEARS)
    gates = {"sanity": series.sanity(o).select("symbol", "passed"), "staleness": series.staleness(o, cal, F.lit("1998-08-02").cast("date"), 120), "calendar_monotonic": series.monotonic(o, "seq")}
    return series.quarantine(series.report(gates))


def reconcile_stores(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_suppkey % 7 != 3 or l_returnflag = 'N'")
    net = li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("close"))
    out = series.reconcile(prices(spark, sf).select("symbol", "date", "close"), net, ["close"])
    return _r(out, 6, "worst_delta")


def dedup_keep_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return series.keep_last(e, ["user_id", "date"], [F.desc("ts"), F.desc("event_id")])


def windowed_read(spark, sf):
    wanted = table(spark, sf, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("symbol"))
    return _r(series.read_window(prices(spark, sf), wanted, F.lit("1998-06-30").cast("date"), 730, ["close"]), 6, "close")


def missing_symbols(spark, sf):
    wanted = table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"))
    return series.missing_symbols(prices(spark, sf), wanted)


def settled_only(spark, sf):
    o = table(spark, sf, "orders").withColumn("settled", F.col("o_orderstatus") == "F")
    return series.settled_only(o).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def correction_asof(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    return series.as_corrected(o, ["o_custkey", "o_orderpriority"], "o_orderkey", "date", F.lit("1996-06-30").cast("date")).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


def universe_keep(spark, sf):
    m = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    return series.universe(prices(spark, sf), m).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def universe_drop(spark, sf):
    m = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    return series.universe(prices(spark, sf), m, keep=False).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def pit_membership(spark, sf):
    o = table(spark, sf, "orders")
    rosters = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.last_day("o_orderdate").alias("change_date")).agg(F.array_sort(F.collect_set("o_custkey")).alias("tickers"))
    asked = table(spark, sf, "events").select(F.to_date(F.col("ts")).alias("asked")).distinct()
    return series.roster_at(asked.union(o.select(F.to_date("o_orderdate")).distinct()), rosters, "asked").select("asked", F.coalesce(F.size("tickers"), F.lit(-1)).alias("n_members"), F.array_join("tickers", ",").alias("members"))


def _daily(spark, sf):
    return series.returns(prices(spark, sf))


def risk_stats(spark, sf):
    return _r(risk.risk_stats(_daily(spark, sf), ["symbol"], "ret"), 7, "mean", "volatility", "sharpe", "downside", "sortino")


def var_cvar(spark, sf):
    return _r(risk.value_at_risk(_daily(spark, sf), ["symbol"], "ret"), 7, "var_param", "cvar_param", "var_hist", "cvar_hist")


def max_drawdown(spark, sf):
    return _r(risk.max_drawdown(prices(spark, sf), ["symbol"], "date", "close"), 8, "max_drawdown")


def twr(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).cast("double").alias("flow"))
    return _r(risk.time_weighted_return(p, ["account"], "t", "value", "flow"), 5, "twr")


def expectancy_by_group(spark, sf):
    return _r(risk.expectancy(table(spark, sf, "events"), ["event_type"], "value", threshold=50.0), 7, "hit_rate", "avg_win", "avg_loss", "win_loss", "expectancy")


def sharpe_significance(spark, sf):
    return _r(risk.sharpe_significance(_daily(spark, sf), ["symbol"], "ret"), 6, "sharpe", "psr")


def newey_west(spark, sf):
    return _r(risk.newey_west(_daily(spark, sf), ["symbol"], "date", "ret"), 7, "mean", "std_error")


def bootstrap_interval(spark, sf):
    return _r(risk.bootstrap_mean(table(spark, sf, "events"), ["event_type"], "value", "event_id"), 6, "mean", "low", "high")


def wilson_interval(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.select("l_returnflag", "l_linestatus", "hits", "n", risk.wilson(F.col("hits"), F.col("n")).alias("w")).select("l_returnflag", "l_linestatus", "hits", "n", F.round("w.low", 8).alias("low"), F.round("w.high", 8).alias("high"))


def xirr_by_account(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"))
    return _r(risk.internal_rate(o, "o_custkey", "o_orderdate", "amount"), 6, "irr")


def ic_by_bucket(spark, sf):
    return _r(evaluation.information_coefficient(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 8, "ic")


def ece(spark, sf):
    s = table(spark, sf, "alpha_signals").select((1 / (1 + F.exp(-F.col("score")))).alias("p"), F.when(F.col("market_regime").isNotNull(), (F.col("market_regime") == "bull").cast("double")).alias("y"))
    return _r(evaluation.calibration(s, "p", "y"), 8, "predicted", "observed", "ece")


def seam_spread(spark, sf):
    s = table(spark, sf, "alpha_signals").select(F.to_date("signal_ts").alias("d"), "score", "horizon_days")
    return _r(evaluation.seam_spread(s, s.filter("horizon_days = 21"), "d", "score", least_names=2), 8, "spread")


def bh_fdr(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", ((F.col("p_retailprice") * 7919) % 1000 / 1000 * F.when(F.col("p_size") < 5, 0.001).otherwise(1.0)).alias("p"))
    return _r(evaluation.false_discoveries(t, "p_partkey", "p"), 9, "p")


def pbo(spark, sf):
    ic = prices(spark, sf).groupBy(F.year("date").alias("split"), (F.col("symbol") % 12).alias("spec")).agg(F.round(F.avg("close"), 6).alias("ic"))
    return evaluation.overfitting(ic, "split", "spec", "ic")


def _alphas(spark, sf):
    s = table(spark, sf, "alpha_signals")
    return s.select(F.col("market_regime").alias("regime"), F.col("horizon_days").alias("horizon"), evaluation.log_alpha(F.col("score") / 100, F.lit(0.001)).alias("alpha"), (F.col("score") > 0.1).alias("beat"))


def regime_sortino(spark, sf):
    return _r(evaluation.regime_sortino(_alphas(spark, sf), "regime", "horizon", "alpha", "beat"), 7, "hit_rate", "sortino", "sharpe", "downside")


def regime_spread(spark, sf):
    return _r(evaluation.regime_spread(evaluation.regime_sortino(_alphas(spark, sf), "regime", "horizon", "alpha", "beat"), 21), 7, "up", "down", "spread")


def _days(spark, sf):
    return prices(spark, sf).select("date").distinct()


def ew_high_vol(spark, sf):
    out = evaluation.high_volatility_benchmark(_daily(spark, sf), _days(spark, sf), lookback=20, least=20)
    return _r(out, 7, "ret")


def _two_series(spark, sf):
    r = _daily(spark, sf).filter("ret is not null")
    return r.groupBy("date").agg(F.avg(F.when(F.col("symbol") % 3 == 0, F.col("ret"))).alias("p"), F.avg("ret").alias("m")).filter("p is not null and m is not null")


def beta_matched(spark, sf):
    return _r(evaluation.beta_matched(_two_series(spark, sf), "p", "m"), 6, "beta", "ret")


def alpha_vs_benchmark(spark, sf):
    x = _two_series(spark, sf).withColumns({"p": F.col("p") / 1000, "m": F.col("m") / 1000})
    return _r(evaluation.alpha_against(x.select("date", F.col("p").alias("ret")), x.select("date", F.col("m").alias("ret"))), 8, "portfolio_return", "benchmark_return", "alpha", "information_ratio")


_QUERIES = [price_series_daily, outlier_gate, sanity_gate, schema_gate, staleness_gate, continuity_gate, monotonic_gate, quarantine_decision, reconcile_stores, dedup_keep_last, windowed_read, missing_symbols, settled_only, correction_asof, universe_keep, universe_drop, pit_membership]
_QUERIES += [risk_stats, var_cvar, max_drawdown, twr, expectancy_by_group, sharpe_significance, newey_west, bootstrap_interval, wilson_interval, xirr_by_account, ic_by_bucket, ece, seam_spread, bh_fdr, pbo, regime_sortino, regime_spread, ew_high_vol, beta_matched, alpha_vs_benchmark]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_SERIES = "o as (select o_custkey symbol, o_orderdate::date date, o_orderkey seq, o_totalprice close from orders)"
_SANITY = "select symbol, count(*) filter (where close <= 0) = 0 passed from o group by 1"
_STALE = "select symbol, max(date) newest, (select count(*) from days where days.date > max(o.date) and days.date <= date '1998-08-02') age from o group by 1"
_BACK = "select *, lag(date) over (partition by symbol order by seq) > date back from o"
_MONO = "select symbol, count(date) - count(distinct date) n_repeated, count(*) filter (where back) n_back from b group by 1"
_REG = """a as (select market_regime regime, horizon_days horizon, ln(1 + score / 100) - ln(1.001) a, (score > 0.1)::int b from alpha_signals
where market_regime is not null and horizon_days is not null and score is not null),
g as (select regime, horizon, count(*) n, avg(b) hit, avg(a) m, sqrt(avg(least(a, 0) ** 2)) d, stddev_samp(a) sd, sqrt(252.0 / horizon) f from a group by 1, 2)"""
_SORTINO = "case when n >= 5 and d >= 1e-12 then m / d * f end"
_SEG = """dd as (select distinct date from prices),
wk as (select date, date_trunc('week', date - interval 1 day)::date + 1 w from dd),
mk as (select date, coalesce(lag(w) over (order by date) <> w, true) reb from wk),
sg as (select date, reb, sum(reb::int) over (order by date) segment from mk)"""
_TWO = "two as (select * from (select date, avg(ret) filter (where symbol % 3 = 0) p, avg(ret) m from rets where ret is not null group by 1) where p is not null and m is not null)"


def oracle_sql() -> dict[str, str]:
    lags = "least(floor(4 * (n / 100.0) ** (2.0 / 9)), n - 1)"
    nw = " + ".join(f"case when {j} <= lags then 2 * (1 - {j} / (lags + 1)) * e * coalesce(lag(e, {j}) over (partition by symbol order by date), 0) else 0 end" for j in range(1, 9))
    edges = [i * 0.1 for i in range(10)] + [1.0]
    bin_case = "case " + " ".join(f"when p >= {edges[i]!r}::double and p {'<=' if i == 9 else '<'} {edges[i + 1]!r}::double then {i}" for i in range(10)) + " end"
    return {
        "price_series_daily": f"with {PRICES} select symbol, date, round(close, 6) close, volume from prices",
        "outlier_gate": f"""with {RETURNS}, v as (select *, count(*) over (partition by symbol) n_rows,
case when count(ret) over w >= 5 and max(ret) over w > min(ret) over w then stddev_samp(ret) over w end vol from rets
window w as (partition by symbol order by date rows between 20 preceding and 1 preceding))
select symbol, date, round(ret, 8) ret, round(vol, 8) vol from v where n_rows >= 7 and abs(ret) > 2 * vol""",
        "sanity_gate": """select c_nationkey symbol, count(*) filter (where c_acctbal <= 0) n_bad,
coalesce(array_to_string((list_sort(list(distinct c_custkey) filter (where c_acctbal <= 0)))[1:5], ','), '') first_dates, count(*) filter (where c_acctbal <= 0) = 0 passed
from customer group by 1""",
        "schema_gate": """select state_machine_arn symbol, 'open' absent, count(*) filter (where output is not null and try_cast(output as double) is null)::bigint n_not_numeric, false passed
from run_executions group by 1""",
        "staleness_gate": f"with {CALENDAR}, {_SERIES}, s as ({_STALE}) select symbol, newest, age, age <= 120 passed from s",
        "continuity_gate": f"""with {PRICES}, {CALENDAR}, s as (select symbol, count(*) n, min(date) a, max(date) b from prices group by 1),
e as (select symbol, n, (select count(*) from days where date between a and b) x from s),
h as (select symbol, count(*) c from prices join days using (date) group by 1)
select e.symbol, case when n < 2 then 0 else x - coalesce(c, 0) end n_missing, case when n < 2 then true else x = coalesce(c, 0) end passed from e left join h using (symbol)""",
        "monotonic_gate": f"with {_SERIES}, b as ({_BACK}), m as ({_MONO}) select *, n_repeated = 0 and n_back = 0 passed from m",
        "quarantine_decision": f"""with {CALENDAR}, {_SERIES}, b as ({_BACK}), m as ({_MONO}), s as ({_STALE}),
g as (select symbol, 'sanity' gate, passed from ({_SANITY}) union all select symbol, 'staleness', age <= 120 from s
union all select symbol, 'calendar_monotonic', n_repeated = 0 and n_back = 0 from m)
select symbol, coalesce(bool_or(not passed and gate in ('schema', 'sanity', 'calendar_monotonic')), false) quarantine, bool_or(not passed) alarm,
coalesce(string_agg(gate, ',' order by gate) filter (where not passed), '') failed_gates from g group by 1""",
        "reconcile_stores": f"""with {PRICES}, net as (select l_suppkey symbol, l_shipdate::date date, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) close from lineitem
where l_suppkey % 7 <> 3 or l_returnflag = 'N' group by 1, 2),
n as (select symbol, count(*) nb from net group by 1), p as (select symbol, count(*) na from prices group by 1),
d as (select a.symbol, count(*) n_cells, count(*) filter (where abs(a.close - b.close) > 1e-6) n_over, max(abs(a.close - b.close)) worst, arg_max(a.date, struct_pack(d := abs(a.close - b.close), o := -(a.date - date '1970-01-01'))) worst_date
from prices a join net b on a.symbol = b.symbol and a.date = b.date group by 1)
select coalesce(p.symbol, n.symbol) symbol, case when na is null then 'only_b' when nb is null then 'only_a' else 'both' end side,
coalesce(na, 0) - coalesce(nb, 0) row_delta, coalesce(n_cells, 0) n_cells, coalesce(n_over, 0) n_over, round(worst, 6) worst_delta, worst_date
from p full join n on p.symbol = n.symbol left join d on d.symbol = coalesce(p.symbol, n.symbol)""",
        "dedup_keep_last": "select user_id, ts::date date, ts, event_id, value from events qualify row_number() over (partition by user_id, ts::date order by ts desc, event_id desc) = 1",
        "windowed_read": f"""with {PRICES} select symbol, date, round(close, 6) close from prices
where date >= date '1998-06-30' - 730 and date <= date '1998-06-30' and symbol in (select s_suppkey from supplier where s_nationkey < 5)""",
        "missing_symbols": "select p_partkey symbol from part where p_partkey not in (select l_suppkey from lineitem)",
        "settled_only": "select o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderstatus = 'F' group by 1",
        "correction_asof": """select o_custkey, o_orderpriority, o_orderkey, o_totalprice from orders where o_orderdate::date <= date '1996-06-30'
qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey desc) = 1""",
        "universe_keep": f"with {PRICES} select symbol, count(*) n from prices where symbol in (select s_suppkey from supplier where s_acctbal > 0) group by 1",
        "universe_drop": f"with {PRICES} select symbol, count(*) n from prices where symbol not in (select s_suppkey from supplier where s_acctbal > 0) group by 1",
        "pit_membership": """with r as (select last_day(o_orderdate) change_date, list_sort(list_distinct(list(o_custkey))) n from orders where o_orderpriority = '1-URGENT' group by 1),
a as (select distinct ts::date asked from events union all select distinct o_orderdate::date from orders),
f as (select asked, min_by(n, change_date) n from (select distinct asked from a) join r on change_date > asked group by 1)
select a.asked, coalesce(len(n), -1)::int n_members, array_to_string(n, ',') members from a left join f on a.asked = f.asked""",
        "risk_stats": f"""with {RETURNS}, g as (select symbol, count(ret) n, avg(ret) m, stddev_samp(ret) sd, sqrt(avg(least(ret, 0) ** 2)) d, max(ret) > min(ret) sp from rets where ret is not null group by 1)
select symbol, n, round(m, 7) mean, round(case when n >= 2 then sd * sqrt(252) end, 7) volatility, round(case when n >= 2 and sp then m / sd * sqrt(252) end, 7) sharpe,
round(case when n >= 2 then d end, 7) downside, round(case when n >= 2 and d <> 0 then m / d * sqrt(252) end, 7) sortino from g""",
        "var_cvar": f"""with {RETURNS}, c as (select symbol, ret r from rets where ret is not null),
g as (select symbol, count(r) n, avg(r) m, stddev_samp(r) sd, greatest(quantile_cont(-r, 0.95), 0) v, max(-r) worst from c group by 1),
t as (select c.symbol, avg(-r) tail from c join g on c.symbol = g.symbol where -r >= v group by 1)
select g.symbol, n, round(case when n >= 2 then greatest(1.6448536269514715 * sd - m, 0) end, 7) var_param,
round(case when n >= 2 then greatest(sd * {0.10313564037537139 / 0.05!r} - m, 0) end, 7) cvar_param, round(v, 7) var_hist, round(greatest(coalesce(tail, worst), 0), 7) cvar_hist
from g left join t on g.symbol = t.symbol""",
        "max_drawdown": f"""with {PRICES}, k as (select *, max(close) over (partition by symbol order by date) peak from prices)
select symbol, round(case when count(*) >= 2 and min(peak) > 0 then min(close / peak - 1) end, 8) max_drawdown from k group by 1""",
        "twr": """with p as (select o_custkey account, o_orderdate::date t, sum(o_totalprice) v, count(*)::double f from orders group by 1, 2),
s as (select account, v, lag(v + f) over (partition by account order by t) b from p)
select account, round(case when min(b) > 0 then product(v / b) - 1 end, 5) twr from s where b is not null group by 1""",
        "expectancy_by_group": """with x as (select event_type, value - 50 e from events where event_type is not null and value is not null),
g as (select event_type, count(*) n, count(*) filter (where e > 0) wins, avg(e) filter (where e > 0) w, avg(-e) filter (where e <= 0) l from x group by 1)
select event_type, n, case when n < 10 then 'insufficient' when wins = 0 then 'no_wins' when wins = n then 'no_losses' else 'ok' end status,
round(case when n >= 10 then wins / n end, 7) hit_rate, round(case when n >= 10 then w end, 7) avg_win, round(case when n >= 10 then l end, 7) avg_loss,
round(case when n >= 10 and l <> 0 then w / l end, 7) win_loss,
round(case when n >= 10 then wins / n * coalesce(w, 0) - (1 - wins / n) * coalesce(l, 0) end, 7) expectancy from g""",
        "newey_west": f"""with {RETURNS}, x as (select symbol, date, ret, count(*) over w n, avg(ret) over w m from rets where ret is not null window w as (partition by symbol)),
y as (select symbol, date, n, m, ret - m e, {lags} lags from x), z as (select symbol, n, m, e * e + {nw} s from y)
select symbol, max(n) n, round(max(m), 7) mean, round(case when max(n) >= 2 then sqrt(greatest(sum(s), 0)) / max(n) end, 7) std_error from z group by 1""",
        "wilson_interval": """with g as (select l_returnflag, l_linestatus, count(*) filter (where l_discount > 0.05) hits, count(*) n from lineitem group by 1, 2),
p as (select *, hits / n p, 1.959963984540054 z from g)
select l_returnflag, l_linestatus, hits, n,
round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))), 8) low,
round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))), 8) high from p""",
        "ic_by_bucket": """with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 a,
rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 b from lineitem)
select l_returnflag, count(*) n, round(corr(a, b), 8) ic, 'ok' status from r group by 1""",
        "ece": f"""with x as (select 1 / (1 + exp(-score)) p, (market_regime = 'bull')::int::double y from alpha_signals where score is not null and market_regime is not null),
b as (select {bin_case} bin, p, y from x), g as (select bin, count(*) n, avg(p) predicted, avg(y) observed from b where bin is not null group by 1)
select bin, n, round(predicted, 8) predicted, round(observed, 8) observed, true kept, round(sum(n * abs(predicted - observed)) over () / sum(n) over (), 8) ece from g""",
        "seam_spread": """with c as (select signal_ts::date d, score, horizon_days from alpha_signals),
a as (select d, avg(score) i, count(score) ni from c group by 1 having count(score) >= 2), b as (select d, avg(score) o, count(score) no from c where horizon_days = 21 group by 1 having count(score) >= 2)
select count(*) filter (where i is not null and o is not null) n_dates, count(*) filter (where i is null or o is null) n_dropped, sum(ni)::bigint n_input, sum(no)::bigint n_output,
round(avg(o - i), 8) spread, case when count(o - i) >= 1 then 'ok' else 'insufficient_data' end status from a full join b on a.d = b.d""",
        "bh_fdr": """with t as (select p_partkey, (p_retailprice * 7919) % 1000 / 1000 * case when p_size < 5 then 0.001 else 1.0 end p from part),
r as (select *, row_number() over (order by p, p_partkey) rank, count(*) over () n from t)
select p_partkey, round(p, 9) p, rank, rank <= coalesce((select max(rank) from r where p <= rank / n * 0.05), 0) significant from r""",
        "pbo": f"""with {PRICES}, x as (select year(date) split, symbol % 12 spec, round(avg(close), 6) v from prices group by 1, 2),
s as (select count(distinct spec) n from x), k as (select *, count(*) over (partition by split) c from x), y as (select k.*, n from k, s where c = n),
o as (select *, (sum(v) over (partition by spec) - v) / (count(*) over (partition by spec) - 1) others,
(rank() over (partition by split order by v) + (count(*) over (partition by split, v) - 1) / 2.0) / (n + 1.0) w from y),
b as (select * from o qualify row_number() over (partition by split order by round(others, 12) desc, spec) = 1)
select count(*) n_splits, (select n from s)::int n_specs, round(case when count(*) >= 4 then avg((ln(w / (1 - w)) <= 0)::int) end, 6) pbo, round(case when count(*) >= 4 then quantile_cont(ln(w / (1 - w)), 0.5) end, 6) median_logit from b""",
        "regime_sortino": f"""with {_REG} select regime, horizon, n, round(case when n >= 5 then hit end, 7) hit_rate, round({_SORTINO}, 7) sortino,
round(case when n >= 5 and sd >= 1e-12 then m / sd * f end, 7) sharpe, round(case when n >= 5 then d end, 7) downside from g""",
        "regime_spread": f"""with {_REG}, s as (select max({_SORTINO}) filter (where regime = 'bull') up, max({_SORTINO}) filter (where regime = 'bear') down from g where horizon = 21)
select round(up, 7) up, round(down, 7) down, round(up - down, 7) spread,
case when up - down is null then 'insufficient_sample' when up - down > 0.3 then 'useful' when up - down > -0.3 then 'neutral' else 'inverted' end verdict from s""",
        "ew_high_vol": f"""with {RETURNS}, {_SEG}, x as (select symbol, r.date, ret, reb, segment, case when count(ret) over w >= 20 then stddev_samp(ret) over w end vol
from rets r join sg on r.date = sg.date window w as (partition by symbol order by r.date rows between 20 preceding and 1 preceding)),
a as (select symbol, segment, vol from x where reb and vol is not null), c as (select segment, quantile_cont(vol, 0.75) cut from a group by 1),
h as (select symbol, a.segment from a join c on a.segment = c.segment where vol >= cut)
select x.date, round(avg(ret), 7) ret, count(ret) n_names from x join h on x.symbol = h.symbol and x.segment = h.segment where not reb and ret is not null group by 1""",
        "beta_matched": f"""with {RETURNS}, {_TWO}, wk as (select *, date_trunc('week', date - interval 1 day)::date + 1 w from two),
mk as (select *, coalesce(lag(w) over (order by date) <> w, true) reb from wk),
b as (select *, case when reb and count(p) over v >= 60 then covar_samp(p, m) over v / var_samp(m) over v end b0 from mk window v as (order by date rows between 60 preceding and 1 preceding)),
h as (select *, last_value(b0 ignore nulls) over (order by date) beta from b)
select date, round(beta, 6) beta, round(beta * m, 6) ret from h where not reb and beta is not null""",
        "alpha_vs_benchmark": f"""with {RETURNS}, {_TWO}, x as (select p / 1000 p, m / 1000 b from two),
g as (select count(*) n, exp(sum(ln(1 + p))) - 1 tp, exp(sum(ln(1 + b))) - 1 tb, avg(p - b) m, stddev_samp(p - b) sd from x)
select n n_days, round(tp, 8) portfolio_return, round(tb, 8) benchmark_return, round(tp - tb, 8) alpha, round(case when sd > 1e-12 then m / sd * sqrt(252) else 0 end, 8) information_ratio from g""",
    }
