import math
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.calendar import count_trading_days, holidays, previous_trading_day, trading_days
from tidemark.functions.numeric import finite, normal_cdf, rank_percent
from tidemark.operators import lookup as lk


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -3.3, -1.0, 0.0, 0.5, 2.0, 7.2, 12.0, None]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got, strict=True):
        assert p is None if x is None else math.isclose(p, 0.5 * math.erfc(-x / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-14)


def test_finite(spark):
    got = [r.y for r in spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "x double").select(finite(F.col("x")).alias("y")).collect()]
    assert got == [None, None, 1.5, None]


def test_rank_percent_matches_pandas(spark):
    v = [3.0, 1.0, 1.0, None, 2.0, 3.0, 3.0]
    got = {r.i: r.p for r in spark.createDataFrame(list(enumerate(v)), "i int, v double").withColumn("g", F.lit(1)).select("i", rank_percent(F.col("v"), ["g"]).alias("p")).collect()}
    want = pd.Series(v, dtype=float).rank(pct=True) * 100
    for i, w in want.items():
        assert got[i] is None if np.isnan(w) else math.isclose(got[i], w)


def test_calendar(spark):
    h = set(holidays(2024, 2026))
    assert date(2026, 7, 3) in h and date(2026, 7, 1) not in h and date(2024, 3, 29) in h and date(2025, 1, 9) in h and date(2024, 6, 19) in h
    cal = trading_days(spark, 2026, 2026)
    d = spark.createDataFrame([(date(2026, 7, 6),)], "d date")
    assert previous_trading_day(d, cal, "d", "p").first().p == date(2026, 7, 2)
    span = spark.createDataFrame([(date(2026, 6, 30), date(2026, 7, 7))], "a date, b date")
    assert count_trading_days(span, cal, "a", "b", "n").first().n == 5


def test_lookup_spreads_hot_keys_and_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(lk, "HOT", 50)
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [("k" + str(i % 40), i) for i in range(80)] + [(None, 1)], "k string, i int")
    one = spark.createDataFrame([("hot", "H"), ("k1", "1"), ("zzz", "z")], "k string, v string")
    got = lk.lookup(rows, one, "k").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"H": 300, "1": 2, None: 79}
    assert lk.lookup(rows, one, "k", "inner").count() == 302
