"""Broadcasting objects of this package to executors that don't have it installed."""

from __future__ import annotations

from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def share(spark: SparkSession, value: Any) -> Any:
    """A broadcast of ``value`` with its classes by value; a plain broadcast would name them, and workers would have to import them."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Any) -> Any:
    return cloudpickle.loads(shared.value)
