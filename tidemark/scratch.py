"""Written intermediate tables in the shared folder of the cluster.

Iterative operators cut their lineage by writing a round's table and reading it back.  The folder is the one named in
``spark.checkpoint.dir``; only where that is unset, as in tests, a local folder is made and set.  Written tables survive
the loss of executors, and a round's table can be dropped as soon as the next one is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a local one only where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder, making the folders above the target."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """The names below a folder; none where it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


class Scratch:
    """The written tables of one operator call, in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark/{operator}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0
        _KEPT.append((spark, self.root))

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove written tables that no later plan reads."""
        for t in tables:
            if t is not None and (path := self._paths.pop(id(t), None)):
                remove(self.spark, path)


def _clean() -> None:
    for spark, root in _KEPT:
        try:
            remove(spark, root)
        except Exception:  # noqa: BLE001, S110 - the JVM may be gone already
            pass


atexit.register(_clean)
