"""Series of prices: reads, quality gates, reconciliation.

A price table is long, (symbol, date, close, ...), one row per symbol and day.  A symbol's window is as long as its history in days,
whatever the size of the data; all of a table's gates share one partitioning by symbol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite

BLOCKING = ("schema", "sanity", "calendar_monotonic")


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by ``order``; null keys are a key.  Equal rows give one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def read_window(prices: DataFrame, symbols: DataFrame | None, end: Column, lookback_days: int, columns: list[str], seq: str | None = None) -> DataFrame:
    """The last ``lookback_days`` up to ``end`` of the wanted symbols (all if None), the later arrival where a day came twice."""
    day = F.col("date").cast("date")
    out = prices.filter((day >= F.date_sub(end, lookback_days)) & (day <= end))
    if symbols is not None:
        out = out.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    if seq:
        out = keep_last(out, ["symbol", "date"], [F.desc(seq)])
    return out.select("symbol", "date", *columns)


def missing_symbols(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """Wanted symbols without any row."""
    return symbols.select("symbol").distinct().join(prices.select("symbol"), "symbol", "left_anti")


def settled_only(rows: DataFrame) -> DataFrame:
    """Only settled rows, where the table tells; a null flag isn't settled."""
    return rows.filter(F.coalesce("settled", F.lit(False))) if "settled" in rows.columns else rows


def as_corrected(versions: DataFrame, keys: list[str], version: str, known: str, at: Column) -> DataFrame:
    """The latest version per key of those known at ``at``; corrections are rows of their own and nothing is pruned."""
    return keep_last(versions.filter(F.col(known) <= at), keys, [F.desc(version)])


def universe(rows: DataFrame, members: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose symbol is a member, or those whose isn't; rows of null or empty symbol are no members'."""
    m = members.select("symbol").filter(F.col("symbol").isNotNull() & (F.col("symbol").cast("string") != "")).distinct()
    return rows.join(m, "symbol", "left_semi" if keep else "left_anti")


def roster_at(asked: DataFrame, changes: DataFrame, date: str) -> DataFrame:
    """``asked`` with the roster in force at ``date``: a roster holds until before its change date, so the first change strictly after
    rules; null after the last change."""
    # only dates are ordered and carry the change's date back; the roster itself is joined once
    day = asked.select(F.col(date).alias("t")).filter("t is not null").distinct().select("t", F.lit(1).alias("side"), F.lit(None).cast("date").alias("c"))
    both = day.unionByName(changes.select(F.col("change_date").alias("t"), F.lit(0).alias("side"), F.col("change_date").cast("date").alias("c")).filter("t is not null"))
    after = Window.partitionBy().orderBy("t", "side").rowsBetween(1, Window.unboundedFollowing)  # distinct days, of which there are some ten thousand in a lifetime
    rules = both.withColumn("rules", F.first("c", ignorenulls=True).over(after)).filter("side = 1").select(F.col("t").alias(date), F.col("rules").alias("change_date"))
    return asked.join(rules, date, "left").join(changes.select("change_date", "tickers"), "change_date", "left").drop("change_date")


def returns(prices: DataFrame, price: str = "close", fill: bool = False) -> DataFrame:
    """``prices`` with ret, the change on the row before; ``fill`` carries the last price over gaps first."""
    by = Window.partitionBy("symbol").orderBy("date")
    p = F.last(F.col(price), ignorenulls=True).over(by) if fill else F.col(price)
    with_p = prices.withColumn("__p", p)
    before = F.lag("__p").over(by)
    return with_p.withColumn("ret", F.when(before != 0, F.col("__p") / before - 1)).drop("__p")


def outliers(prices: DataFrame, n_sigma: float = 6.0, window: int = 20, least: int = 5) -> DataFrame:
    """Rows whose return exceeds ``n_sigma`` of the volatility of the ``window`` returns before it; abstains on fewer than ``least`` of
    them, on zero volatility and on series of fewer than seven positive prices."""
    x = finite(F.col("close"))
    r = returns(prices.filter(x > 0))
    trailing = Window.partitionBy("symbol").orderBy("date").rowsBetween(-window, -1)
    n, sd = F.count("ret").over(trailing), F.stddev_samp("ret").over(trailing)
    flat = F.max("ret").over(trailing) == F.min("ret").over(trailing)
    rows = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    vol = r.select("symbol", "date", "close", "ret", F.when((n >= least) & ~flat, sd).alias("vol"), rows.alias("rows"))
    return vol.filter((F.col("rows") >= 7) & (F.abs("ret") > n_sigma * F.col("vol"))).drop("rows")


def sanity(prices: DataFrame) -> DataFrame:
    """Per symbol: n_bad, the rows of price at or below zero, and the first five of their dates."""
    bad = F.col("close") <= 0
    return prices.groupBy("symbol").agg(
        F.count_if(bad).alias("n_bad"),
        F.slice(F.array_sort(F.collect_set(F.when(bad, F.col("date")))), 1, 5).alias("first_dates"),
        (F.count_if(bad) == 0).alias("passed"),
    )


def schema_gate(rows: DataFrame, required: list[str], numeric: list[str]) -> DataFrame:
    """Per symbol: the required columns that are absent, and the cells of the numeric ones that aren't numbers."""
    absent = [c for c in required if c not in rows.columns]
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(f"bad_{c}") for c in numeric if c in rows.columns]
    out = rows.groupBy("symbol").agg(*bad) if bad else rows.select("symbol").distinct()
    total = reduce(lambda a, b: a + b, [F.col(f"bad_{c}") for c in numeric if c in rows.columns], F.lit(0))
    return out.select("symbol", F.lit(",".join(absent)).alias("absent"), total.alias("n_not_numeric"), ((total == 0) & F.lit(not absent)).alias("passed"))


def staleness(prices: DataFrame, calendar: DataFrame, as_of: Column, max_age: int) -> DataFrame:
    """Per symbol: the newest day and its age in trading days at ``as_of``; passed within ``max_age``."""
    newest = prices.groupBy("symbol").agg(F.max(F.col("date").cast("date")).alias("newest"))
    days = F.broadcast(calendar)
    age = newest.select("newest").distinct().join(days, (F.col("date") > F.col("newest")) & (F.col("date") <= as_of), "left").groupBy("newest").agg(F.count("date").alias("age"))
    return newest.join(age, "newest").select("symbol", "newest", "age", (F.col("age") <= max_age).alias("passed"))


def continuity(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per symbol: the number of trading days between its first and last day that are missing, by counts alone: expected from the ordinals,
    present by a broadcast join with the calendar."""
    day = F.col("date").cast("date").alias("date")
    have = prices.select("symbol", day).distinct()
    span = have.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    on = have.join(F.broadcast(calendar), "date").groupBy("symbol").agg(F.count(F.lit(1)).alias("present"))
    lo = F.broadcast(calendar.select(F.col("date").alias("d1"), F.col("ordinal").alias("o1")))
    expected = span.join(lo, (F.col("d1") >= F.col("first")) & (F.col("d1") <= F.col("last")), "left").groupBy("symbol", "n_rows").agg(F.count("d1").alias("expected"))
    out = expected.join(on, "symbol", "left").select("symbol", "n_rows", "expected", F.coalesce("present", F.lit(0)).alias("present"))
    missing = F.when(F.col("n_rows") < 2, 0).otherwise(F.col("expected") - F.col("present"))
    return out.select("symbol", missing.alias("n_missing"), (missing == 0).alias("passed"))


def monotonic(rows: DataFrame, seq: str) -> DataFrame:
    """Per symbol: repeated dates anywhere, and rows that arrived after a later date, in the order of ``seq``."""
    w = Window.partitionBy("symbol").orderBy(seq)
    marked = rows.select("symbol", F.col("date").alias("d"), (F.lag("date").over(w) > F.col("date")).alias("back"))
    out = marked.groupBy("symbol").agg((F.count("d") - F.count_distinct("d")).alias("n_repeated"), F.count_if("back").alias("n_back"))
    return out.withColumn("passed", (F.col("n_repeated") == 0) & (F.col("n_back") == 0))


def report(gates: dict[str, DataFrame]) -> DataFrame:
    """(symbol, gate, passed) of several gates' results."""
    return reduce(DataFrame.unionByName, [g.select("symbol", F.lit(n).alias("gate"), "passed") for n, g in gates.items()])


def quarantine(gate_report: DataFrame, blocking: tuple[str, ...] = BLOCKING) -> DataFrame:
    """Per symbol: quarantine if a blocking gate failed, alarm if any did, with the failed gates."""
    failed = ~F.col("passed")
    return gate_report.groupBy("symbol").agg(
        F.coalesce(F.bool_or(failed & F.col("gate").isin(*blocking)), F.lit(False)).alias("quarantine"),
        F.bool_or(failed).alias("alarm"),
        F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("gate")))), ",").alias("failed_gates"),
    )


def reconcile(a: DataFrame, b: DataFrame, values: list[str], epsilon: float = 1e-6) -> DataFrame:
    """Per symbol of either store: where it is, the difference in rows, and over the days both have: cells compared, over ``epsilon`` or
    null on one side only, and the worst difference with its column and date (first by column, then date)."""
    na, nb = a.groupBy("symbol").agg(F.count(F.lit(1)).alias("na")), b.groupBy("symbol").agg(F.count(F.lit(1)).alias("nb"))
    sides = na.join(nb, "symbol", "full_outer")
    pick = lambda t, n: t.select("symbol", "date", *[F.col(v).alias(f"{n}_{v}") for v in values])
    both = pick(a, "a").join(pick(b, "b"), ["symbol", "date"])
    cell = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"a_{v}").alias("x"), F.col(f"b_{v}").alias("y")) for v in values]))
    cells = both.select("symbol", "date", cell.alias("c")).select("symbol", "date", "c.*").filter("x is not null or y is not null")
    delta = F.abs(F.col("x") - F.col("y"))
    over = F.coalesce(delta > epsilon, F.lit(True))
    worst = F.max_by(F.struct("column", "date"), F.struct(delta.alias("d"), (-F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("o")))
    stats = cells.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(over).alias("n_over"), F.max(delta).alias("worst_delta"), worst.alias("w"))
    side = F.when(F.col("na").isNull(), "only_b").when(F.col("nb").isNull(), "only_a").otherwise("both")
    return sides.join(stats, "symbol", "left").select(
        "symbol", side.alias("side"), (F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))).alias("row_delta"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("n_over", F.lit(0)).alias("n_over"), "worst_delta", F.col("w.date").alias("worst_date")
    )
