import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.llm.dedup import History, id_part, page_part, repeats


def brute(rows):
    held, out = {}, set()
    for d, ts, *parts in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[0])):
        hit = {held[p] for p in parts if p is not None and p in held}
        if hit:
            out |= {(d, h) for h in hit if h != d}
        else:
            held.update({p: d for p in parts if p is not None})
    return out


def test_greedy_acceptance_in_any_number_of_deliveries(spark):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    part = lambda c: rng.choice([None, f"{c}hot", f"{c}{rng.randrange(25)}", f"{c}{rng.randrange(25)}"])
    rows = [(f"d{i:03d}", t0 + timedelta(hours=rng.randrange(200)) if rng.random() > 0.05 else None, part("e"), part("u")) for i in range(150)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc string, ts timestamp_ntz, a string, b string").withColumn("parts", F.lit("clash"))
    for n in (0, 1, 100):
        got = {tuple(r)[:2] for r in repeats(df, doc="doc", ts="ts", parts=[F.col("a"), F.col("b")], daily=n).collect()}
        assert got == brute(rows)


def test_history_is_opened_again_by_another_session(spark, tmp_path):
    rng, t0 = random.Random(8), datetime(2024, 1, 1)
    part = lambda c: rng.choice([None, f"{c}hot", f"{c}{rng.randrange(40)}"])
    rows = [(f"d{i:03d}", t0 + timedelta(hours=i), part("e"), part("u")) for i in range(96)]
    got, path = set(), f"{tmp_path}/history"
    for k in range(4):  # one UTC day after the other, each in a session that knows nothing of the others
        one = spark.newSession()
        df = one.createDataFrame(rows[24 * k : 24 * (k + 1)], "doc string, ts timestamp_ntz, a string, b string")
        history = History(one, path, buckets=4 if k == 0 else 99)
        assert history.buckets in (4, 2) and history.empty == (k == 0)
        got |= {tuple(r)[:2] for r in repeats(df, doc="doc", ts="ts", parts=[F.col("a"), F.col("b")], history=history).collect()}
        history.forget()  # another catalog
        if k == 2:
            History(one, path).compact(buckets=2)
    assert got == brute(rows)
    again = {tuple(r)[:2] for r in repeats(df, doc="doc", ts="ts", parts=[F.col("a"), F.col("b")], history=History(one, path)).collect()}
    assert again <= got  # delivered once more, nothing is accepted twice
    assert History(one, path).table().groupBy("part").count().filter("count > 1").isEmpty()


def test_a_daily_batch_meets_the_history_bucket_by_bucket(spark, tmp_path):
    history = History(spark, f"{tmp_path}/history", buckets=3)
    rows = [(f"p{i}", f"d{i}", datetime(2024, 1, 1)) for i in range(50)]
    history.append(spark.createDataFrame(rows, "part string, doc string, ts timestamp_ntz"))
    hits = history.holders(spark.createDataFrame([("p1",), ("x",), ("p1",)], "part string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 3 out of 3" in plan and "Exchange" not in plan[plan.rindex("Sort [") :]
    assert [tuple(r) for r in hits.collect()] == [("p1", "d1")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc string, ts timestamp, a string")
    assert repeats(df, doc="doc", ts="ts", parts=[F.col("a")]).count() == 0


def test_ids(spark):
    rows = ["QN:12 ab", " qn_12AB\n", "n/a", "0", "000", "-", "", "unknown", None, "TW-1"]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(id_part(F.col("x"), F.lit("S")).alias("p")).collect()]
    assert got[0] == got[1] == "id s qn12ab" and got[2:9] == [None] * 7 and got[9] == "id s tw1"


def test_pages(spark):
    same = [
        "https://filings.site.example/a/x-1/doc.htm", "http://filings.site.example:80/a/x-1/doc.htm", "HTTPS://www.Filings.Site.EXAMPLE:443/a/x%2D1/doc.htm/", "https://m.filings.site.example/a/x-1/doc.htm#top",
        "https://amp.filings.site.example/a/x-1/doc.htm?utm_source=a&gclid=b", " https://mobile.filings.site.example//a/x-1/doc.htm?ref=q#:~:text=z ",
    ]
    other = ["https://filings.site.example/a/x-1-2/doc.htm", "https://site.example/a/x-1/doc.htm", "https://site.example/story?id=1&edition=us", "https://site.example/story?id=1&edition=intl"]
    equal = ["https://site.example/story?id=1&edition=us", "https://www.site.example/story/?edition=us&cmpid=9&id=1"]
    none = ["https://site.example/", "https://www.site.example", "", "n/a", None, "https://site.example/?utm_source=x"]
    key = lambda xs: [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(page_part(F.col("x")).alias("p")).collect()]
    assert len(set(key(same))) == 1 and len(set(key(other + same[:1]))) == 5 and len(set(key(equal))) == 1 and key(none) == [None] * 6
