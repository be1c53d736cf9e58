"""Queries of the streaming twins on the events table, and of the sources through a written round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.retrieval import mirror
from tidemark.scratch import Scratch
from tidemark.session import table
from tidemark.sources import tables
from tidemark.streaming import windows


def stream_tumbling(spark, sf):
    return windows.tumbling(table(spark, sf, "events"), "ts", ["event_type"], "value", "1 day").withColumn("total", F.round("total", 4)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_sessions(spark, sf):
    out = windows.sessions(table(spark, sf, "events"), "ts", ["user_id"], "12 hours")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def stream_dedup(spark, sf):
    return windows.deduplicated(table(spark, sf, "events").select("ts", "user_id", "event_type", "event_id"), "ts", ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


def stream_live_tumbling(spark, sf):
    """The same windows through a stream over the file, run to its end."""
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = windows.tumbling(source, "ts", ["event_type"], "value", "1 day")
    windows.once(out, "tidemark_tumbling", "complete")
    done = spark.table("tidemark_tumbling")
    return done.withColumn("total", F.round("total", 4)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_sliding(spark, sf):
    out = windows.sliding(table(spark, sf, "events"), "ts", ["event_type"], "value", "6 hours", "2 hours")
    return out.withColumn("total", F.round("total", 4)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def stream_running_totals(spark, sf):
    """The last state of each key of a stream over the file, run to its end."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    windows.once(windows.running_totals(source.filter("event_type is not null"), "event_type", "value"), "tidemark_totals", "update")
    done = spark.table("tidemark_totals")
    return done.groupBy(F.col("key").alias("event_type")).agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 3).alias("total"))


def corpus_round_trip(spark, sf):
    """Documents and chunks mirrored to the flat corpus and read back through its partitions."""
    s = Scratch(spark, "corpus")
    d = table(spark, sf, "rag_documents").select("id", "ticker", "sector", "source", "title", "url", "doc_type", "filed_date")
    path = s.path("mirror")
    mirror(d.withColumn("document_id", F.col("id")), table(spark, sf, "rag_chunks"), path)
    back = tables.corpus(spark, path, ["10-K", "news"], "2023-03-01")
    return back.groupBy("doc_type", F.trunc("filed_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


def versioned_store(spark, sf):
    """Two versions of a library written and read as of the first and the second."""
    s = Scratch(spark, "store")
    store = tables.Store(spark, s.path("root"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"))
    store.write("universe", o, 1)
    store.write("universe", o.filter("symbol % 10 = 0").withColumn("close", F.col("close") + 1), 2, "restated", "test")
    old, new = store.current("universe", 1), store.current("universe")
    pick = lambda x, v: x.agg(F.lit(v).alias("as_of"), F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total"), F.count("reason").alias("n_corrected"))
    return pick(old, 1).unionByName(pick(new, 2))


_QUERIES = [stream_tumbling, stream_sessions, stream_dedup, stream_live_tumbling, stream_sliding, stream_running_totals, corpus_round_trip, versioned_store]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    tumbling = "select strftime(date_trunc('day', ts), '%Y-%m-%d') window_start, event_type, count(*) n, round(sum(value), 4) total from events where ts is not null group by 1, 2"
    return {
        "stream_tumbling": tumbling,
        "stream_live_tumbling": tumbling,
        "stream_sliding": """with x as (select event_type, value, time_bucket(interval 2 hour, ts, timestamp '1970-01-01') - interval 1 hour * unnest([0, 2, 4]) w from events where ts is not null)
select strftime(w, '%Y-%m-%d %H:%M') window_start, event_type, count(*) n, round(sum(value), 4) total from x group by 1, 2""",
        "stream_running_totals": "select event_type, count(*) n, round(sum(coalesce(value, 0)), 3) total from events where event_type is not null group by 1",
        "stream_sessions": """with x as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 12 hour, true)::int b from events where ts is not null window w as (partition by user_id order by ts)),
s as (select user_id, sum(b) over (partition by user_id order by ts rows unbounded preceding) i from x), g as (select user_id, i, count(*) n from s group by 1, 2)
select user_id, count(*) n_sessions, max(n) longest from g group by 1""",
        "stream_dedup": "select user_id, event_type, event_id from events where ts is not null qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
        "corpus_round_trip": """select doc_type, date_trunc('month', filed_date)::date "month", count(*) n, sum(length(content))::bigint n_chars from rag_documents d join rag_chunks c on c.document_id = d.id
where doc_type in ('10-K', 'news') and filed_date >= date '2023-03-01' group by 1, 2""",
        "versioned_store": """select 1 as_of, count(*) n, round(sum(o_totalprice), 2) total, 0 n_corrected from orders
union all select 2, count(*), round(sum(o_totalprice + (o_orderkey % 10 = 0)::int), 2), count(*) filter (where o_orderkey % 10 = 0) from orders""",
    }
