"""Tables below a root folder: separate libraries, versioned writes, listings, JSON documents, the flat corpus.

A library is a folder of Parquet; settled and preliminary data lie in different libraries, so a reader of one can't meet the other.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, FloatType, IntegerType, StringType, StructField, StructType

from tidemark.scratch import children, remove, rename

LIBRARIES = ("universe", "macro", "preliminary")

#: one row per chunk of the flat corpus
CORPUS = StructType(
    [StructField(n, StringType()) for n in ("document_id", "ticker", "sector", "source", "title", "url")]
    + [StructField("chunk_index", IntegerType()), StructField("content", StringType()), StructField("section_label", StringType()), StructField("embedding", ArrayType(FloatType()))]
    + [StructField("doc_type", StringType()), StructField("filed_date", DateType())]
)


class Store:
    """The libraries below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, library: str) -> str:
        if library not in LIBRARIES:
            raise ValueError(f"no such library: {library}")
        return f"{self.root}/{library}"

    def exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, library: str) -> DataFrame:
        """A library as it is; one that isn't there is an error, never made by reading."""
        path = self._path(library)
        if not self.exists(path):
            raise FileNotFoundError(f"library {library} is not in {self.root}")
        return self.spark.read.parquet(path)

    def write(self, library: str, rows: DataFrame, version: int, reason: str | None = None, source: str | None = None) -> None:
        """Append a version; earlier ones stay.  Rows lie by a hash of the symbol, so a read of some symbols prunes files by their ranges."""
        meta = {"version": F.lit(version).cast("bigint"), "reason": F.lit(reason).cast("string"), "source": F.lit(source).cast("string"), "knowledge_time": F.current_timestamp()}
        out = rows.withColumns(meta).repartition("symbol").sortWithinPartitions("symbol", "date")
        out.write.mode("append").parquet(self._path(library))

    def current(self, library: str, version: int | None = None) -> DataFrame:
        """The latest version of each (symbol, date), or the latest up to ``version``."""
        rows = self.read(library)
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        names = [c for c in rows.columns if c not in ("symbol", "date")]
        best = rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*names), "version").alias("r"))
        return best.select("symbol", "date", *[F.col(f"r.{n}").alias(n) for n in names])


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(key, modified, size) of the files below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.col("path").alias("key"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def json_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, body) of whole JSON files; body is null where it isn't JSON."""
    text = spark.read.option("wholetext", "true").text(paths).withColumn("key", F.input_file_name())
    return text.select("key", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("body"))


def first_readable(documents: DataFrame, priority: Column) -> DataFrame:
    """The readable document of smallest priority, as one row or none."""
    return documents.filter("body is not null").orderBy(priority, "key").limit(1)


def eval_artifacts(documents: DataFrame, n_recent: int | None = None) -> DataFrame:
    """Documents whose file is named by ten digits, in their order, the last ``n_recent`` of them."""
    named = documents.withColumn("run_id", F.regexp_extract("key", r"/(\d{10})\.json$", 1)).filter("run_id != '' and body is not null")
    if n_recent is not None:
        named = named.orderBy(F.desc("run_id")).limit(n_recent)
    return named.orderBy("run_id")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyMMddHHmm")


def artifact_key(prefix: str, run: str, basename: str = "result.json") -> str:
    return f"{prefix.rstrip('/')}/{run}.json" if basename == "result.json" else f"{prefix.rstrip('/')}/{run}_{basename}"


def corpus(spark: SparkSession, root: str, doc_types: list[str] | None = None, filed_from: str | None = None) -> DataFrame:
    """The flat corpus below ``root``, pruned by its partitions; an empty one has its schema."""
    rows = spark.read.schema(CORPUS).parquet(root)
    if doc_types:
        rows = rows.filter(F.col("doc_type").isin(doc_types))
    if filed_from:
        rows = rows.filter(F.col("filed_date") >= F.lit(filed_from).cast("date"))
    return rows


def write_json_lines(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_decisions(rows: DataFrame, path: str) -> None:
    """Decision records by day and agent."""
    day = {"year": F.year("captured_at"), "month": F.month("captured_at"), "day": F.dayofmonth("captured_at")}
    rows.withColumns(day).write.mode("append").partitionBy("year", "month", "day", "agent_id").json(path)


class TrialCounter:
    """Counted trials as an append-only table: increments can't collide, the count is a sum."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, producer: str, n: int, run_date: str) -> None:
        if n > 0:
            self.spark.createDataFrame([(producer, n, run_date)], "producer string, n bigint, run_date string").write.mode("append").parquet(self.path)

    def seed(self, totals: dict[str, int], run_date: str, overwrite: bool = False) -> None:
        """Start from known totals; refused where any is counted already, unless ``overwrite`` counts up or down to them."""
        now = {r.producer: r.n for r in self.totals().collect()}
        if any(now.values()) and not overwrite:
            raise ValueError("trials are counted already")
        rows = [(p, n - now.get(p, 0), run_date) for p, n in totals.items() if n != now.get(p, 0)]
        if rows:
            self.spark.createDataFrame(rows, "producer string, n bigint, run_date string").write.mode("append").parquet(self.path)

    def totals(self) -> DataFrame:
        if not Store(self.spark, self.path).exists(self.path):
            return self.spark.createDataFrame([], "producer string, n bigint")
        return self.spark.read.parquet(self.path).groupBy("producer").agg(F.sum("n").alias("n"))


def vectors_checked(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """``rows`` if ``column`` is an array of numbers, else an error; rows of another length than ``dim`` fail the query."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, ArrayType):
        raise TypeError(f"{column} is {kind.simpleString()}, not an array")
    wrong = F.col(column).isNotNull() & (F.size(column) != dim)
    return rows.withColumn(column, F.when(wrong, F.raise_error(F.lit(f"{column} is not of length {dim}")).cast(kind)).otherwise(F.col(column)))


def embed(texts: DataFrame, key: str, text: str, embedder=None, dim: int = 512) -> DataFrame:
    """(key, embedding) by ``embedder(list of texts) -> array``, called once per Arrow batch; without one, a hashing embedder of signed word
    counts, for tests and offline use.  Null texts have null vectors."""
    import re
    from zlib import crc32

    import numpy as np

    def hashed(batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), dim), np.float32)
        for i, t in enumerate(batch):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = crc32(w.encode())
                out[i, h % dim] += 1 if h & (1 << 31) else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    call = embedder or hashed

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        has = t.notna()
        out = pd.Series([None] * len(t), index=t.index, dtype=object)
        if has.any():
            for i, v in zip(t.index[has], call(t[has].tolist()), strict=True):
                out[i] = v
        return out

    return texts.select(key, run(text).alias("embedding"))


class Transaction:
    """Appends that become visible together: they are written beside the tables and moved into them when all are done."""

    def __init__(self, store: Database):
        self.store, self.id, self.staged = store, uuid.uuid4().hex, []

    def append(self, table: str, rows: DataFrame) -> None:
        path = f"{self.store.root}/_staged/{self.id}/{table}"
        rows.write.parquet(path)
        self.staged.append((table, path))

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            for table, path in self.staged:
                rename(self.store.spark, path, f"{self.store.root}/{table}/{self.id}")
        remove(self.store.spark, f"{self.store.root}/_staged/{self.id}")


class Database:
    """Tables below a root folder with parametrised SQL; a table is a folder of appended batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def available(self) -> bool:
        """Whether the root folder is there."""
        try:
            return Store(self.spark, self.root).exists(self.root)
        except Exception:  # noqa: BLE001 - a file system that can't be reached isn't available
            return False

    def read(self, table: str) -> DataFrame | None:
        path = f"{self.root}/{table}"
        return self.spark.read.option("recursiveFileLookup", "true").parquet(path) if Store(self.spark, path).exists(path) else None

    def query(self, sql: str, params: dict | None = None) -> DataFrame:
        """``sql`` with named parameters (:name) over the tables, which it names as views."""
        for table in children(self.spark, self.root):
            if not table.startswith("_"):
                self.read(table).createOrReplaceTempView(table)
        return self.spark.sql(sql, args=params or {})

    def insert(self, table: str, rows: DataFrame) -> None:
        """One batch, however many rows."""
        with self.transaction() as t:
            t.append(table, rows)

    def transaction(self) -> Transaction:
        return Transaction(self)


def readable_in_window(objects: DataFrame, asked: DataFrame, max_age_days: int) -> DataFrame:
    """``asked``(run_date) with the newest of ``objects``(source_date, key, body) at or before it, no older than ``max_age_days``, whose body is
    JSON: body, source_date, age_days, key; null where there is none.  Corrupt bodies are passed over."""
    sound = objects.filter(F.try_parse_json("body").isNotNull()).groupBy("source_date").agg(F.max_by("body", "key").alias("body"), F.max("key").alias("key"))
    days = asked.select("run_date").distinct().select("run_date", F.explode(F.sequence(F.lit(0), F.lit(max_age_days))).alias("age_days")).withColumn("source_date", F.date_sub("run_date", F.col("age_days")))
    best = days.join(sound, "source_date").groupBy("run_date").agg(F.min_by(F.struct("body", "source_date", "age_days", "key"), "age_days").alias("b"))
    return asked.join(best, "run_date", "left").select("run_date", "b.body", "b.source_date", "b.age_days", "b.key")


def latest_key(prefix: str) -> str:
    return f"{prefix.rstrip('/')}/latest.json"


def latest_artifact(documents: DataFrame, prefix: str) -> DataFrame:
    """The document that the pointer latest.json below ``prefix`` names in artifact_key, of ``documents``(key, body); no row where pointer or
    document isn't there or isn't JSON."""
    sound = documents.filter(F.try_parse_json("body").isNotNull())
    pointer = sound.filter(F.col("key") == latest_key(prefix)).select(F.get_json_object("body", "$.artifact_key").alias("key")).limit(1)
    return sound.join(F.broadcast(pointer), "key", "left_semi")


def macro_series(store: Store, symbols: list[str], start: str, end: str) -> DataFrame:
    """The named series of the macro library within [start, end]; it is no universe, so symbols must be named."""
    if not symbols:
        raise ValueError("name the macro series to read")
    return store.read("macro").filter(F.col("symbol").isin(symbols) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


@contextmanager
def phase(spark: SparkSession, path: str, run: str, name: str, skip_done: bool = False):
    """A phase of a run: appends a marker (run, phase, status, seconds, detail) below ``path`` when it ends, also in failure.  Yields whether there
    is work to do: with ``skip_done`` none where the phase has an 'ok' marker already."""
    schema = "run string, phase string, status string, seconds double, detail string"
    done = skip_done and bool(children(spark, path)) and not spark.read.schema(schema).parquet(path).filter((F.col("run") == run) & (F.col("phase") == name) & (F.col("status") == "ok")).isEmpty()
    began, status, detail = time.monotonic(), "ok", None
    try:
        yield not done
    except Exception as e:
        status, detail = "error", f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        if not done:
            spark.createDataFrame([(run, name, status, time.monotonic() - began, detail)], schema).write.mode("append").parquet(path)
