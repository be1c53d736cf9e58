"""Graphs, runs, records, retrieval, sources and streams on small cases."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage, records, retrieval, runs
from tidemark.sources import connectors, tables
from tidemark.streaming import windows


def test_closure_leaves_roots_and_cycles(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), (None, "a")], "id string, depends_on string")
    got = {(r.id, r.depends_on): r.distance for r in lineage.reachable(e, "id", "depends_on").collect()}
    assert got[("c", "a")] == 2 and got[("x", "x")] == 2 and ("a", "c") not in got
    assert {(r.id, r.leaf) for r in lineage.reachable_leaves(e.filter("id in ('b','c','d')")).collect()} == {("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}
    gaps = spark.createDataFrame([("c",), ("b",), ("d",)], "id string")
    assert {(r.id, r.root) for r in lineage.root_causes(e.filter("id in ('b','c','d')"), gaps).collect()} == {("b", "b"), ("c", "b"), ("d", "b")}
    assert {r.id for r in lineage.on_cycles(e.filter("id is not null")).collect()} == {"x", "y"}
    assert lineage.on_cycles(e.limit(0)).count() == 0


def test_ticks(spark):
    rows = [("2026-07-04 08:59:00", "weekly"), ("2026-07-04 09:00:00", "weekly"), ("2026-07-05 00:00:00", "daily"), ("2026-07-06 12:00:00", "daily"), ("2026-07-06 12:34:56", "continuous")]
    df = spark.createDataFrame(rows, "t string, c string").select(lineage.cycle_tick(F.col("t").cast("timestamp"), F.col("c"), F.lit(30)).alias("x"))
    assert [r.x for r in df.collect()] == [datetime(2026, 6, 27, 9), datetime(2026, 7, 4, 9), datetime(2026, 7, 3, 13), datetime(2026, 7, 3, 13), datetime(2026, 7, 6, 12, 30)]


def test_runs(spark):
    rows = [("r", i, s) for i, s in enumerate(["a", "a", None, "b", "b", "a"])]
    df = spark.createDataFrame(rows, "run string, n int, s string")
    assert [(r.position, r.state) for r in runs.entered_states(df, "run", "n", F.col("s")).orderBy("position").collect()] == [(1, "a"), (2, "b"), (3, "a")]
    assert sorted((r["first"], r.length) for r in runs.runs_of(df, ["run"], "n", F.col("s")).collect()) == [(0, 2), (2, 1), (3, 2), (5, 1)]
    c = spark.createDataFrame([("m", i, ok) for i, ok in enumerate([True, False, True, True])] + [("k", 0, True)], "m string, c int, ok boolean")
    assert {r.m: r.clean_streak for r in runs.clean_streak(c, "m", "c", F.col("ok")).collect()} == {"m": 2, "k": 1}


def test_run_date(spark):
    df = spark.createDataFrame([('{"run_date": "2024-01-02"}', "x", None), ("cut {", "run-2024-02-30", datetime(2024, 5, 6)), (None, "run-2024-03-04-1", None)], "i string, n string, s timestamp")
    assert [r.d for r in df.select(runs.run_date(F.col("i"), F.col("n"), F.col("s")).alias("d")).collect()] == [date(2024, 1, 2), date(2024, 5, 6), date(2024, 3, 4)]


SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"$ref": "#/defs/tag"}}, "defs": {"tag": {"enum": ["x", "y"]}}}


def test_records(spark):
    texts = ['{"a": 1, "b": "x", "more": 1}', '{"a": 0, "b": "q"}', '{"b": "x"}', "{cut", None, '{"a": 1.5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", records.conformance_errors(SCHEMA)(F.col("t")).alias("e")).collect()}
    assert got[0] == [] and len(got[1]) == 2 and got[2] == ["$: a is missing"] and got[3] == ["not JSON"] and got[4] is None and got[5] == ["$.a: is not of type integer"]
    h = {r.i: r.h for r in spark.createDataFrame([(0, '{"b":1,"a":[1,2]}'), (1, '{ "a" : [1, 2], "b" : 1 }'), (2, None)], "i int, t string").select("i", records.canonical_hash(F.col("t")).alias("h")).collect()}
    assert h[0] == h[1] and h[2] is None
    m = spark.createDataFrame([("short longenough1  x",), ("",), (None,)], "t string").select(records.mask(F.col("t")).alias("m")).collect()
    assert [r.m for r in m] == ["short ***[len=11]  x", "", None]
    big = json.dumps({"a": "x" * 500, "b": 1})
    cut = json.loads(spark.createDataFrame([(big,)], "t string").select(records.truncated(100)(F.col("t")).alias("t")).first().t)
    assert cut["b"] == 1 and cut["a"]["truncated"]
    with pytest.raises(ValueError, match="teacher"):
        records.assert_single_teacher(spark.createDataFrame([("a",), (None,)], "m string"), "m")


def test_retrieval(spark):
    corpus = spark.createDataFrame([(1, "alpha beta companies", [1.0, 0.0]), (2, "beta gamma", [0.6, 0.8]), (3, None, None), (4, "the of", [0.0, 0.0]), (5, "", [1.0])], "id int, text string, v array<float>")
    q = spark.createDataFrame([(9, "Beta company", [1.0, 0.0])], "query_id int, text string, vector array<float>")
    v = {r.id: (r["rank"], r.similarity) for r in retrieval.vector_search(q, corpus, "id", "v", 5).collect()}
    assert v[1] == (1, 1.0) and v[2][0] == 2 and v[3][1] is None and v[4][1] is None
    assert [r.id for r in retrieval.keyword_search(q, corpus, "id", "text", 5).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in retrieval.retrieve(q, corpus, key="id", vector="v", text="text", method="hybrid", k=2).orderBy("rank").collect()] == [1, 2]
    ranked = retrieval.retrieve(q, corpus.filter("text is not null"), key="id", vector="v", text="text", k=2, pool=3, scorer=lambda a, b: b.str.len() * 1.0)
    assert [r.id for r in ranked.orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.retrieve(q, corpus, key="id", vector="v", text="text", method="psychic")


def test_store_counter_and_corpus(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read("macro")
    d = spark.createDataFrame([("a", date(2026, 1, 1), 1.0)], "symbol string, date date, close double")
    store.write("universe", d, 1)
    store.write("universe", d.withColumn("close", F.lit(2.0)), 2, "fix", "me")
    assert store.current("universe").first().close == 2.0 and store.current("universe", 1).first().close == 1.0
    c = tables.TrialCounter(spark, str(tmp_path / "trials"))
    assert c.totals().count() == 0
    c.add("p", 3, "2026-01-01")
    c.add("p", 4, "2026-01-02")
    c.add("p", 0, "2026-01-03")
    assert c.totals().first().n == 7
    e = tables.embed(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), "k", "t", dim=8).orderBy("k").collect()
    assert len(e[0].embedding) == 8 and e[1].embedding is None
    with pytest.raises(TypeError):
        tables.vectors_checked(d, "close", 3)


def test_connector(spark):
    def fetch(options, ticker):
        yield ticker, f"{options['prefix']}-{ticker}"

    connectors.register(spark, "fake_news", "ticker string, title string", fetch)
    got = spark.read.format("fake_news").option("tickers", "A, B").option("prefix", "p").load().collect()
    assert sorted(map(tuple, got)) == [("A", "p-A"), ("B", "p-B")]


def test_stream_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = windows.running_totals(spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in")), "k", "v")
    windows.once(out, "totals_test", "update")
    assert {r.key: (r.n, r.total) for r in spark.table("totals_test").collect()} == {"a": (2, 3.0), "b": (1, 0.0)}
