"""The NYSE trading calendar, built from the public rules; every calendar question is a join on the ordinal."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    if n > 0:
        d = date(year, month, 1)
        return d + timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))
    d = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return d - timedelta((d.weekday() - weekday) % 7)


def _easter(y: int) -> date:
    """Gregorian Easter by the anonymous computus."""
    a, b, c = y % 19, y // 100, y % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(y, month, day + 1)


def _observed(d: date) -> date | None:
    """A Saturday's holiday is kept on Friday, a Sunday's on Monday."""
    return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d


def holidays(first_year: int, last_year: int) -> list[date]:
    out = []
    for y in range(first_year, last_year + 1):
        new_year = date(y, 1, 1)
        out += [] if new_year.weekday() == 5 else [_observed(new_year)]
        out += [_nth(y, 1, 0, 3)] if y >= 1998 else []
        out += [_nth(y, 2, 0, 3), _easter(y) - timedelta(2), _nth(y, 5, 0, -1)]
        out += [_observed(date(y, 6, 19))] if y >= 2022 else []
        out += [_observed(date(y, 7, 4)), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4), _observed(date(y, 12, 25))]
    # fixed values: closings of a day for mourning, storms and attacks
    special = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
    out += [d for d in map(date.fromisoformat, special) if first_year <= d.year <= last_year]
    return sorted(set(out))


def trading_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, ordinal): one row per trading day; a few thousand rows whatever the data."""
    closed = set(holidays(first_year, last_year))
    d, days = date(first_year, 1, 1), []
    while d.year <= last_year:
        if d.weekday() < 5 and d not in closed:
            days.append(d)
        d += timedelta(1)
    return spark.createDataFrame([(x, i) for i, x in enumerate(days)], "date date, ordinal int")


def previous_trading_day(dates: DataFrame, calendar: DataFrame, column: str, name: str) -> DataFrame:
    """``dates`` with the last trading day before ``column``."""
    days = F.broadcast(calendar.select(F.col("date").alias("__d"), F.col("ordinal").alias("__o")))
    gap = dates.select(column).distinct()
    prev = gap.join(days, F.col("__d") < F.col(column)).groupBy(column).agg(F.max("__d").alias(name))
    return dates.join(prev, column, "left")


def count_trading_days(spans: DataFrame, calendar: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``spans`` with the number of trading days in [start, end]."""
    days = F.broadcast(calendar)
    key = spans.select(start, end).distinct()
    n = key.join(days, (F.col("date") >= F.col(start)) & (F.col("date") <= F.col(end)), "left").groupBy(start, end).agg(F.count("date").alias(name))
    return spans.join(n, [start, end], "left")
