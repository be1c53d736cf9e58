"""Numeric column expressions: what is not finite is null, what is undefined is null."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

TRADING_DAYS = 252


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(b != 0, a / b)


def spread_is_zero(c: Column) -> Column:
    """Aggregate: whether all values are equal; safer than comparing a standard deviation to 0."""
    return F.max(c) == F.min(c)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_density(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# fixed values: coefficients of Hart's rational approximation of the normal distribution function (double precision)
_HART_P = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-02)
_HART_Q = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function as a column expression, to 1e-14 absolute; it needs no Python."""
    a = F.abs(x)

    def poly(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * a + F.lit(c)
        return out

    near = F.exp(-a * a / 2) * poly(_HART_P) / poly(_HART_Q)
    far = F.exp(-a * a / 2) / (math.sqrt(2 * math.pi) * (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))))
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x.isNotNull(), F.when(x > 0, 1 - tail).otherwise(tail))


def average_rank(value: Column, by: list) -> Column:
    """Rank within ``by`` with ties sharing their mean rank; nulls rank among themselves, so filter them first or mask the result."""
    over = Window.partitionBy(*by)
    return F.rank().over(over.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def rank_percent(value: Column, by: list) -> Column:
    """Average-rank percentile in (0, 100]; null where ``value`` is null; nulls don't count."""
    n = F.count(value).over(Window.partitionBy(*by))
    null_last = average_rank(F.coalesce(value, F.lit(float("inf"))), by)
    return F.when(value.isNotNull(), null_last / n * 100)


def quantile_slots(values: DataFrame, by: list[str], value: str, slots: int = 256) -> DataFrame:
    """``values`` with __slot, the place of ``value`` among the approximate quantiles of its group: about even, and in the order of the values."""
    width = math.isqrt(slots)
    quantiles = F.percentile_approx(value, [(i + 1) / slots for i in range(slots - 1)], 10_000)
    edges = values.groupBy(*by).agg(quantiles.alias("__edges")).withColumn("__coarse", F.filter("__edges", lambda _, i: (i + 1) % width == 0))
    joined = values.join(edges, by) if by else values.crossJoin(F.broadcast(edges))
    below = lambda array: F.size(F.filter(array, lambda e: e < F.col(value)))
    # first among every width-th edge, then among the few between two of them
    first = joined.withColumn("__first", below(F.col("__coarse")) * width)
    fine = F.slice("__edges", F.col("__first") + 1, F.lit(width))
    return first.withColumn("__slot", F.col("__first") + below(fine)).drop("__edges", "__coarse", "__first")


def value_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name): the mean rank of every distinct value within its group; null values are left out.

    Values are counted first, so ties meet on the map side; the counts are written, then added up slot by slot of the group's quantiles and
    inside each slot, so that no task sorts a whole group."""
    s = Scratch(rows.sparkSession, "ranks")
    counts = s.write(rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), "counts")
    counts = s.write(quantile_slots(counts, by, value), "slots")
    before = counts.groupBy(*by, "__slot").agg(F.sum("__n").alias("__sum"))
    over = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*by, "__slot", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(before, [*by, "__slot"])
    return own.select(*by, value, (F.col("__before") + F.col("__inside") + (F.col("__n") + 1) / 2.0).alias(name))


def mean_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the rank of ``value`` within its group, ties sharing their mean rank; rows of null values or groups are left out."""
    return rows.join(value_ranks(rows, by, value, name), [*by, value])
