"""Streaming twins: watermarked windows, sessions, deduplication and per-key state over event streams.

Each takes a DataFrame with an event-time column, streaming or not; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull())
    return out.withWatermark(ts, late)


def tumbling(events: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(window_start, by, n, total) per tumbling or sliding window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _timed(events, ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(by, session_start, session_end, n): rows of a key closer than ``gap`` are one session."""
    out = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def sliding(events: DataFrame, ts: str, by: list[str], value: str, width: str, step: str, late: str = "2 hours") -> DataFrame:
    """Count and total per overlapping window of ``width``, one every ``step``; a row falls into width / step of them."""
    out = _timed(events, ts, late).groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row per key within the watermark; on a table, the first by time."""
    timed = _timed(events, ts, late)
    if events.isStreaming:
        return timed.dropDuplicatesWithinWatermark(keys)
    names = [c for c in timed.columns if c not in keys]
    return timed.groupBy(*keys).agg(F.min(F.struct(ts, *[c for c in names if c != ts])).alias("r")).select(*keys, "r.*")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """A stream's (key, n, total) after each micro-batch; the state is one small row per key."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for r in rows:
            n += len(r)
            total += float(r["v"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, name: str, mode: str = "append", seconds: int = 600) -> None:
    """Run a stream over what is there now into a memory table, for tests and backfills; fails after ``seconds``."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream {name} did not end in {seconds} s")
