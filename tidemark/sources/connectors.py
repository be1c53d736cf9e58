"""Connectors as Python data sources: a provider is a function from a request to rows; requests are read in parallel, one task each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NEWS = "ticker string, title string, url string, source string, published_at timestamp, external_id string"
ANALYST = "ticker string, rating string, price_target double, as_of date"
FILINGS = "ticker string, form_type string, filed_date date, url string, title string"


class _Request(InputPartition):
    def __init__(self, ticker: str):
        self.ticker = ticker


def connector(name: str, schema: str, fetch: Callable[[dict[str, str], str], Iterator[tuple]]) -> type[DataSource]:
    """A data source ``name`` whose rows are what ``fetch(options, ticker)`` yields for each of the option ``tickers``."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return [_Request(t.strip()) for t in self.options.get("tickers", "").split(",") if t.strip()]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if isinstance(partition, _Request):
                yield from fetch(self.options, partition.ticker)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def register(spark: SparkSession, name: str, schema: str, fetch: Callable[[dict[str, str], str], Iterator[tuple]]) -> None:
    spark.dataSource.register(connector(name, schema, fetch))
