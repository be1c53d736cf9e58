import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, portfolio, risk, series


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(0.001, 0.02, 120), "b": rng.standard_t(4, 80) * 0.01, "flat": np.full(10, 0.01), "one": np.array([0.1]), "bad": np.array([np.nan, np.inf, 0.1, -0.2])}
    rows = [(g, i, float(v)) for g, vs in x.items() for i, v in enumerate(vs)]
    return x, spark.createDataFrame(rows, "g string, t int, r double")


def test_risk_stats(returns):
    x, df = returns
    got = {r.g: r for r in risk.risk_stats(df, ["g"], "r").collect()}
    a = x["a"]
    assert math.isclose(got["a"].volatility, a.std(ddof=1) * math.sqrt(252)) and math.isclose(got["a"].sharpe, a.mean() / a.std(ddof=1) * math.sqrt(252))
    assert got["flat"].sharpe is None and got["flat"].sortino is None and got["one"].volatility is None and got["bad"].n == 2


def test_sharpe_significance(returns):
    x, df = returns
    got = {r.g: r for r in risk.sharpe_significance(df, ["g"], "r").collect()}
    a = x["a"]
    sr, z = a.mean() / a.std(ddof=1), (a - a.mean()) / a.std()
    denom = math.sqrt(1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr * sr)
    assert math.isclose(got["a"].psr, 0.5 * math.erfc(-sr * math.sqrt(len(a) - 1) / denom / math.sqrt(2)), rel_tol=1e-9)
    assert got["flat"].psr is None


def test_newey_west(returns):
    x, df = returns
    got = {r.g: r for r in risk.newey_west(df, ["g"], "t", "r").collect()}
    a = x["a"]
    e, n = a - a.mean(), len(a)
    lags = int(4 * (n / 100) ** (2 / 9))
    s = (e * e).sum() + 2 * sum((1 - j / (lags + 1)) * (e[j:] * e[:-j]).sum() for j in range(1, lags + 1))
    assert math.isclose(got["a"].std_error, math.sqrt(s / n / n), rel_tol=1e-9)


def test_bootstrap_interval_holds_the_mean_and_is_repeatable(returns):
    _, df = returns
    one = df.withColumn("k", F.concat_ws("-", "g", "t"))
    a = {r.g: r for r in risk.bootstrap_mean(one, ["g"], "r", "k").collect()}
    b = {r.g: r for r in risk.bootstrap_mean(one.repartition(3), ["g"], "r", "k").collect()}
    assert a["a"].low < a["a"].mean < a["a"].high and math.isclose(a["a"].low, b["a"].low, rel_tol=1e-9)
    se = df.filter("g = 'a'").agg(F.stddev_samp("r") / F.sqrt(F.count("r"))).first()[0]
    assert 0.7 < (a["a"].high - a["a"].low) / (2 * 1.96 * se) < 1.3


def test_internal_rate(spark):
    df = spark.createDataFrame([("a", "2020-01-01", -100.0), ("a", "2021-01-01", 110.0), ("b", "2020-01-01", 5.0), (None, "2020-01-01", 5.0)], "k string, t string, v double").withColumn("t", F.to_date("t"))
    got = {r.k: r.irr for r in risk.internal_rate(df, "k", "t", "v").collect()}
    assert math.isclose(got["a"], 1.1 ** (365 / 366) - 1, abs_tol=1e-9) and got["b"] is None


def test_drawdown(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 1.0, 3.0])] + [("b", 0, 1.0), ("c", 0, -1.0), ("c", 1, 2.0)], "g string, t int, v double")
    assert {r.g: r.max_drawdown for r in risk.max_drawdown(df, ["g"], "t", "v").collect()} == {"a": -0.5, "b": None, "c": None}


def test_information_coefficient_states(spark):
    df = spark.createDataFrame([("a", float(i), float(-i)) for i in range(25)] + [("b", 1.0, float(i)) for i in range(25)] + [("c", 1.0, 2.0), ("a", float("nan"), 1.0)], "g string, s double, o double")
    got = {r.g: (r.n, r.ic, r.status) for r in evaluation.information_coefficient(df, ["g"], "s", "o").collect()}
    assert got["a"][0] == 25 and math.isclose(got["a"][1], -1.0) and got["b"][1:] == (0.0, "no_variance") and got["c"][1:] == (None, "insufficient")


def test_false_discoveries_step_up(spark):
    p = [0.001, 0.02, 0.03, 0.039, 0.9, None]
    got = {r.k: r.significant for r in evaluation.false_discoveries(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "k", "p").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_log_alpha_refuses_a_total_loss(spark):
    with pytest.raises(Exception, match="100"):
        spark.createDataFrame([(-1.0,)], "r double").select(evaluation.log_alpha(F.col("r"), F.lit(0.0))).collect()


def test_least_squares_takes_the_least_norm_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    rows = [("a", float(a), float(a), float(2 * a + 1)) for a, _ in x] + [("b", float(a), float(b), float(a - 3 * b)) for a, b in x]
    got = {r.g: r for r in portfolio.least_squares(spark.createDataFrame(rows, "g string, x double, z double, y double"), "g", "y", ["x", "z"]).collect()}
    assert np.allclose(got["a"].betas, [1, 1], atol=1e-6) and np.allclose(got["b"].betas, [1, -3], atol=1e-6)


def test_carino_adds_up(spark):
    rng, rows_p, rows_b = np.random.default_rng(3), [], []
    for t in range(4):
        w, v = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3))
        for g in range(3):
            rows_p.append((t, g, float(w[g]), float(rng.normal(0, 0.05))))
            rows_b.append((t, g, float(v[g]), float(rng.normal(0, 0.05))))
    schema = "t int, g int, w double, r double"
    e = portfolio.brinson(spark.createDataFrame(rows_p, schema), spark.createDataFrame(rows_b, schema), "t", "g")
    out = portfolio.linked(e, "t", "g").agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction"))).first()[0]
    total = lambda rows: math.prod(1 + sum(w * r for tt, _, w, r in rows if tt == t) for t in range(4)) - 1
    assert math.isclose(out, total(rows_p) - total(rows_b), rel_tol=1e-9)


def test_outlier_gate_abstains(spark):
    from datetime import date, timedelta

    day = lambda i: date(2026, 1, 1) + timedelta(i)
    ramp = [("flat", day(i), 10.0) for i in range(30)] + [("few", day(i), 1.0 + 9 * (i == 5)) for i in range(6)] + [("jump", day(i), 10 + 0.1 * (i % 3) + 50 * (i == 25)) for i in range(30)]
    got = series.outliers(spark.createDataFrame(ramp, "symbol string, date date, close double")).collect()
    assert {r.symbol for r in got} == {"jump"} and day(25) in {r.date for r in got}


def test_reconcile_counts_one_sided_nulls(spark):
    from datetime import date

    d = date(2026, 1, 1)
    a = spark.createDataFrame([("x", d, 1.0), ("y", d, None), ("z", d, None), ("only", d, 1.0)], "symbol string, date date, close double")
    b = spark.createDataFrame([("x", d, 1.5), ("y", d, 2.0), ("z", d, None)], "symbol string, date date, close double")
    got = {r.symbol: (r.side, r.n_cells, r.n_over, r.worst_delta) for r in series.reconcile(a, b, ["close"]).collect()}
    assert got == {"x": ("both", 1, 1, 0.5), "y": ("both", 1, 1, None), "z": ("both", 0, 0, None), "only": ("only_a", 0, 0, None)}
