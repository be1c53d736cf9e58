"""Attributes as known at event time.

Events and attribute changes are unioned, put in order of entity and availability time with an explicit priority at ties
(a change that becomes known at the very instant of an event is known to it), and the last known attributes are carried
forward.  "Last" is the largest *rank*, so that a correction which arrives late for an older period doesn't displace a newer
one: what is carried is a running maximum of a struct, which is the plain last value where rank equals availability.

One entity may hold a third of all rows, so an entity is never one window.  Rows fall into spans of time; inside a span the
running maximum is a window over (entity, span), and what came before the span is a running maximum over one row per
(entity, span), whose number is bounded by the length of the history and not by its rows.  Events and changes of equal entity
and time are collapsed before the shuffle, so a burst of copies costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_of(ts: Column) -> Column:
    """Hours since 1970 of a timestamp, with or without a zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def known_at(
    events: DataFrame,
    changes: DataFrame,
    *,
    entity: Column,
    event_time: Column,
    change_entity: Column,
    available_at: Column,
    rank: list[Column],
    tie: Column,
    carry: dict[str, Column],
    span: int = 1,
) -> DataFrame:
    """Every event with the attributes of its entity that were known at its time.

    ``events`` keep all their columns; ``carry`` names the attributes to add (their names must not clash with the events').
    A change counts from ``available_at``; of the changes available the one of largest ``rank`` holds, then of smallest ``tie``.
    ``span``: hours in a span.

    Nulls: an event without entity or time, and a change without entity, availability or rank, match nothing; such events
    come out with null attributes.  Repeated events come out as often as they went in.  Empty tables give empty or null results.
    Extra columns of ``changes`` are ignored.
    """
    if clash := set(carry) & set(events.columns):
        raise ValueError(f"carried attributes clash with columns of the events: {sorted(clash)}")
    e, t = "__entity", "__time"
    keyed = events.withColumns({e: entity, t: event_time})
    moments = keyed.filter(F.col(e).isNotNull() & F.col(t).isNotNull()).select(e, t).distinct()
    ranked = changes.select(
        change_entity.alias(e),
        available_at.alias(t),
        F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]).alias("rank"),
        tie.alias("tie"),
        F.struct(*[c.alias(n) for n, c in carry.items()]).alias("carry"),
    ).filter(F.col(e).isNotNull() & F.col(t).isNotNull() & ~F.exists(F.array(*[F.col(f"rank.r{i}").isNull() for i in range(len(rank))]), lambda x: x))
    # of equal entity, time and rank the smallest tie; then of equal entity and time the largest rank
    known = ranked.groupBy(e, t, "rank").agg(F.min_by("carry", "tie").alias("carry")).groupBy(e, t).agg(F.max_by(F.struct("rank", "carry"), "rank").alias("known"))
    both = moments.select(e, t, F.lit(1).alias("side"), F.lit(None).cast(known.schema["known"].dataType).alias("known")).unionByName(known.select(e, t, F.lit(0).alias("side"), "known"))
    both = both.withColumn("span", F.floor(hour_of(F.col(t)) / span)).repartition(e, "span")
    inside = Window.partitionBy(e, "span").orderBy(t, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(e).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    largest = F.max_by("known", "known.rank")
    spans = both.groupBy(e, "span").agg(largest.alias("own")).select(e, "span", F.max_by("own", "own.rank").over(before).alias("earlier"))
    running = both.withColumn("here", largest.over(inside)).filter("side = 1").join(spans, [e, "span"], "left")
    best = F.when(F.col("earlier").isNull() | (F.col("here.rank") >= F.col("earlier.rank")), F.col("here")).otherwise(F.col("earlier"))
    answers = running.select(e, t, best.alias("__best"))
    return keyed.join(answers, [e, t], "left").select(*events.columns, *[F.col("__best.carry")[n].alias(n) for n in carry])
