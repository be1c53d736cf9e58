import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import entity_key
from tidemark.operators.asof import known_at

CHANGES = "ticker string, filed date, seen timestamp_ntz, id string, known string"
EVENTS = "event long, ticker string, at timestamp_ntz, span string"


def run(spark, events, changes):
    e, c = spark.createDataFrame(events, EVENTS), spark.createDataFrame(changes, CHANGES)
    filed = F.col("filed").cast("timestamp_ntz")
    out = known_at(
        e, c, entity=entity_key(F.col("ticker")), event_time=F.col("at"), change_entity=entity_key(F.col("ticker")),
        available_at=F.when(filed.isNotNull() & F.col("seen").isNotNull(), F.greatest(filed, F.col("seen"))), rank=[F.col("filed"), F.col("seen")], tie=F.col("id"), carry={"doc": F.col("id")},
    )
    return sorted(((r.event, r.doc) for r in out.collect()), key=repr)


def brute(events, changes):
    out = []
    for n, t, at, _ in events:
        best = None
        for ct, filed, seen, i, _ in changes:
            if t and ct and at and filed and seen and t.strip().upper() == ct.strip().upper() != "" and filed <= at.date() and seen <= at:
                rank = (filed, seen)
                if best is None or rank > best[0] or (rank == best[0] and i < best[1]):
                    best = (rank, i)
        out.append((n, best and best[1]))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng, t0 = random.Random(5), datetime(2024, 1, 1)
    moment = lambda: t0 + timedelta(minutes=rng.randrange(0, 6000, 30))
    names = ["HOT"] * 6 + ["b", " B ", "c", None, ""]
    changes = [(rng.choice(names), date(2024, 1, 1) + timedelta(rng.randrange(5)) if rng.random() > 0.05 else None, moment() if rng.random() > 0.05 else None, f"d{i % 70:03d}", "x") for i in range(150)]
    events = [(i, rng.choice(names), moment() if rng.random() > 0.05 else None, "s") for i in range(200)]
    events += events[:3]
    assert run(spark, events, changes) == brute(events, changes)


def test_known_at_the_very_instant_and_never_later(spark):
    at = datetime(2024, 1, 2, 10)
    changes = [("a", date(2024, 1, 1), at, "same", ""), ("a", date(2024, 1, 2), at + timedelta(microseconds=1), "later", "")]
    assert run(spark, [(1, "A", at, "")], changes) == [(1, "same")]


def test_empty_tables_and_clashes(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", datetime(2024, 1, 1), "")], []) == [(1, None)]
    e = spark.createDataFrame([], "doc string, t timestamp_ntz")
    with pytest.raises(ValueError, match="clash"):
        known_at(e, e, entity=F.col("doc"), event_time=F.col("t"), change_entity=F.col("doc"), available_at=F.col("t"), rank=[F.col("t")], tie=F.col("doc"), carry={"doc": F.col("doc")})
