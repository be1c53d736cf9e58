"""Joining many rows to one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
HOT = 100_000  # rows from which a key counts as hot


def lookup(rows: DataFrame, one_per_key: DataFrame, key: str, how: str = "left", at_most: int | None = None) -> DataFrame:
    """``rows`` joined to ``one_per_key`` on ``key``, hot keys spread over ``SALTS`` tasks.

    The hot keys are those of more than ``HOT`` rows, the 1,000 largest of them at most (any other then has less than a thousandth of the
    rows); they are found by one aggregation, which a caller saves who knows that there are ``at_most`` so many rows.  Their rows on the right
    are repeated once per salt.  Null keys match nothing and are kept by a left join.
    """
    if at_most is not None and at_most <= HOT:
        return rows.join(one_per_key, key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[0] for r in counts.filter((F.col("n") > HOT) & F.col(key).isNotNull()).orderBy(F.desc("n")).limit(1000).select(key).collect()]
    if not hot:
        return rows.join(one_per_key, key, how)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("__salt", F.when(is_hot, F.floor(F.rand(7) * SALTS).cast("int")).otherwise(0))
    right = one_per_key.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], how).drop("__salt")
