"""Deduplicating new batches against all history.

What identifies a document is its *parts*: hashes of its normalised content.  Here the parts are its external id within its source and
the page its url leads to; a full copy shares all of them, a partial one some.  A batch's distinct parts are met with the history by a
semi-join on buckets: the history's hashes lie in a bucketed table in a folder of its own, which any later session opens again, so only
the batch is moved.  What is left is decided within the batch in the order of arrival, and the parts of what is accepted are appended.

Within a batch acceptance is sequential (a document that repeats only rejected ones is accepted), but not decided one by one: a document
that is the first undecided one in each of its parts is accepted, those that share a part with it are rejected, and so on; the first
round decides nearly all.  Documents with equal parts are one in these rounds.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import trimmed
from tidemark.operators.lookup import lookup
from tidemark.scratch import Scratch, children, remove

BUCKETS = 64

# fixed values: what stands for a missing id, in normal form; query parameters that track or name the device; subdomains of devices
NO_ID = ["", "na", "nan", "null", "none", "nil", "unknown", "undefined", "missing", "tbd", "test", "notavailable", "notapplicable", "noid"]
TRACKING = r"^(utm_.*|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|cmpid|cmp|campaign|ref|ref_src|referrer|_ga|_gl|spm|cid|amp|outputtype|output|mobile)$"
DEVICES = r"^(?:(?:www\d?|m|mobile|amp|touch|wap)\.)+(?=[^.]+\.)"


def id_part(external_id: Column, source: Column) -> Column:
    """An external id within its source, whatever its letter case, white space and punctuation; null if it identifies nothing."""
    bare = F.lower(F.regexp_replace(external_id, r"[^\p{L}\p{N}]+", ""))
    usable = ~bare.isin(NO_ID) & ~bare.rlike("^0+$")
    return F.when(usable & source.isNotNull(), F.concat(F.lit("id "), F.lower(trimmed(source)), F.lit(" "), bare))


def page_part(url: Column) -> Column:
    """The page a url leads to, without how the address is written, the device it serves and what tracks the visit; null for the
    front page of a site and for what is no address."""
    u = trimmed(url)
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), DEVICES, "")
    tail = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    tail = F.regexp_replace(tail, r"#.*$", "")
    # escapes of ordinary characters are undone; those of the characters that divide an address stay
    plain = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(c, r"(?i)%(2F|3F|23|25|26|3D|2B)", "%25$1"), r"\+", "%2B")), c)
    path = plain(F.regexp_extract(tail, r"^([^?]*)", 1))
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"(?:/(?:index\.(?:html?|php)|amp))?/*$", "")
    query = F.regexp_extract(tail, r"\?(.*)$", 1)
    params = F.filter(F.transform(F.split(query, "[&;]"), plain), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING))
    args = F.array_join(F.array_sort(F.array_distinct(params)), "&")
    return F.when((host != "") & ((path != "") | (args != "")), F.concat(F.lit("url "), host, path, F.lit("?"), args))


class History:
    """The hashes of everything accepted, (part, doc, ts), in a bucketed table below ``path``, which outlives the session.

    The number of buckets is fixed when a history is begun and read from its folder when it is opened again; the catalog only has to know
    the folder, so any session that can read it goes on with it.  A part has one holder, as a document that shares one isn't accepted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, path.rstrip("/")
        done = sorted(f for f in children(spark, self.root) if f.startswith("g") and "_SUCCESS" in children(spark, f"{self.root}/{f}"))
        self.generation, self.buckets = (int(done[-1][1:6]), int(done[-1].split("-b")[1])) if done else (0, buckets)
        self.empty = not done
        self.schema = ""
        if done:
            self._register(self.spark.read.parquet(self.path).schema.simpleString()[7:-1].replace(":", " "))

    @property
    def path(self) -> str:
        return f"{self.root}/g{self.generation:05d}-b{self.buckets}"

    @property
    def name(self) -> str:
        return "tidemark_history_" + md5(self.path.encode()).hexdigest()[:16]

    def _register(self, schema: str) -> None:
        self.spark.sql(f"create table if not exists {self.name} ({schema}) using parquet clustered by (part) sorted by (part) into {self.buckets} buckets location '{self.path}'")
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def holders(self, parts: DataFrame) -> DataFrame:
        """(part, repeats) for the distinct ``parts`` that the history holds; they are dealt to its buckets, it stays where it is."""
        asked = parts.select("part").distinct().repartition(self.buckets, "part")
        return asked.hint("merge").join(self.table().select("part", F.col("doc").alias("repeats")), "part")

    def append(self, parts: DataFrame) -> None:
        rows = parts.select("part", "doc", "ts").repartition(self.buckets, "part")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "part").sortBy("part").option("path", self.path).saveAsTable(self.name)
        self.empty = False

    def compact(self, buckets: int | None = None) -> None:
        """Write the many small files of daily appends as one a bucket, also into another number of buckets; readers of the old ones aren't
        disturbed until the next call, which removes them."""
        if self.empty:
            return
        rows, old = self.table(), [f for f in children(self.spark, self.root) if f.startswith("g") and int(f[1:6]) < self.generation]
        self.generation, self.buckets = self.generation + 1, buckets or self.buckets
        self.append(rows)
        for f in old:
            remove(self.spark, f"{self.root}/{f}")

    def forget(self) -> None:
        """Drop the catalog's entry; the files stay."""
        self.spark.sql(f"drop table if exists {self.name}")


def admit(batch: DataFrame, history: History, s: Scratch) -> DataFrame:
    """Decide ``batch``(doc, ts, parts), append what is accepted to ``history`` and give (doc, repeats, coverage) for what isn't, one row per
    accepted document that it repeats, coverage the share of its parts that this one holds.

    A batch that is admitted again after its parts were appended gives the same but for the pairs within it, and appends nothing."""
    docs = s.write(batch.select("doc", "ts", F.array_sort(F.array_distinct(F.filter("parts", lambda p: p.isNotNull()))).alias("parts")).filter("size(parts) > 0"), "docs")
    rows = docs.agg(F.sum(F.size("parts"))).first()[0] or 0
    long = lambda d, *c: d.select(*c, F.explode("parts").alias("part"))
    pairs, tables = [], [docs]
    if not history.empty:
        # the history meets each part of the batch once, bucket by bucket; a hot one doesn't travel
        hits = history.holders(long(docs))
        met = lookup(long(docs, "doc", F.size("parts").alias("n")), hits, "part", "inner", at_most=rows)
        known = s.write(met.groupBy("doc", "repeats").agg((F.count(F.lit(1)) / F.max("n")).alias("coverage")), "known")
        pairs.append(known)
        fresh = docs.join(known.select("doc").distinct(), "doc", "left_anti")
    else:
        fresh = docs
    # documents of equal parts are one: the first speaks for all
    first = F.min(F.struct("ts", "doc")).alias("at")
    undecided = s.write(fresh.groupBy("parts").agg(first).select("at", "parts"), "undecided")
    accepted = []
    while n := undecided.count():
        heads = long(undecided, "at").groupBy("part").agg(F.min("at").alias("head"))
        each = lookup(long(undecided, "at", "parts"), heads, "part", "inner", at_most=n * rows)
        standing = s.write(each.groupBy("at").agg(F.first("parts").alias("parts"), F.every(F.col("at") == F.col("head")).alias("wins"), F.collect_set("head").alias("heads")), "standing")
        wins = standing.filter("wins").select("at", "parts")
        accepted.append(wins)
        # whoever has a winner before it in one of its parts is out
        lost = standing.filter("not wins").select("at", F.explode("heads").alias("head")).join(wins.select(F.col("at").alias("head")), "head", "left_semi").select("at").distinct()
        left = s.write(standing.filter("not wins").select("at", "parts").join(lost, "at", "left_anti"), "undecided")
        s.drop(undecided)
        tables.append(standing)
        undecided = left
    if accepted:
        won = s.write(long(reduce(DataFrame.unionByName, accepted), F.col("at.doc").alias("doc"), F.col("at.ts").alias("ts")), "accepted")
        holders = won.select("part", F.struct("ts", "doc").alias("holder"))
        inside = lookup(long(docs, F.struct("ts", "doc").alias("at"), F.size("parts").alias("n")), holders, "part", "inner", at_most=rows)
        # a winner holds all its parts itself; the others repeat the holders that came before them
        losers = inside.filter("holder < at").groupBy(F.col("at.doc").alias("doc"), F.col("holder.doc").alias("repeats")).agg((F.count(F.lit(1)) / F.max("n")).alias("coverage"))
        pairs.append(s.write(losers, "pairs"))
        history.append(won)
        tables.append(won)
    out = reduce(DataFrame.unionByName, pairs) if pairs else docs.limit(0).select("doc", F.col("doc").alias("repeats"), F.lit(1.0).alias("coverage"))
    if pairs:
        s.drop(*tables)
    return out


def repeats(documents: DataFrame, *, doc: str, ts: str, parts: list[Column], daily: int = 3, history: History | None = None) -> DataFrame:
    """(doc, repeats, coverage): each document and the earlier accepted ones that it repeats, taken in the order of ``ts``, then ``doc``.

    The last ``daily`` UTC days come as the daily batches they are, each checked against the history of all before; what is older comes in
    one delivery, whose documents are decided among themselves in the same order, so the rows are those of a batch a day.
    With ``history`` the documents are taken after what it holds, and it goes on holding what was accepted; else one is made for the call.
    Nulls: documents without ``ts`` or ``doc`` are left aside; a null part is no part, and a document without any is accepted and repeats
    nothing.  A document delivered again under the same id at another time repeats itself and gives no pair.  Empty tables give no rows.
    Other columns are ignored.
    """
    spark = documents.sparkSession
    s = Scratch(spark, "dedup")
    hashed = F.array(*[F.when(p.isNotNull(), F.md5(p)) for p in parts])
    rows = documents.select(F.col(doc).alias("doc"), F.col(ts).alias("ts"), hashed.alias("parts")).filter("doc is not null and ts is not null")
    rows = s.write(rows, "hashed")
    day = F.to_date("ts")
    last = [r[0] for r in rows.select(day.alias("d")).distinct().orderBy(F.desc("d")).limit(daily).collect()]
    own, found = history or History(spark, s.path("history")), []
    found.append(admit(rows.filter(day < min(last)) if last else rows, own, s))
    for d in sorted(last):
        found.append(admit(rows.filter(day == F.lit(d)), own, s))
    if history is None:
        own.forget()
    return reduce(DataFrame.unionByName, found).filter("doc != repeats")
