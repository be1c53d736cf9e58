"""Session factory and table access.

Operators never build a session; they take the one of their input.  ``get_session`` exists for tests, the bench and
interactive use and only sets what every plan of this library relies on: UTC, adaptive execution, skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
